"""Incremental form of the shard load: new shards only, each exactly once."""
