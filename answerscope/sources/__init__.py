"""Reading shards and results, and bringing their columns to one schema."""
