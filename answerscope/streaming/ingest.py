"""Evaluate shards as they arrive, with the same functions as the batch run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.predict import Model, load_failures
from ..sinks.run_store import RunStore
from ..sources.columns import normalize_input, null_tokens_to_null, with_row_id
from ..sources.shards import CSV_READ_OPTIONS, file_shard

_RECORD = "_odd_record"
SURPLUS = "_surplus_field"


def shard_stream(spark: SparkSession, folder: str, columns: Sequence[str], files_per_batch: int = 1000) -> DataFrame:
    """New ``*.csv`` shards of one header as a stream, tagged with ``_shard``.

    The header of every file is compared with ``columns``: one in another order
    or with other names fails the query instead of being read by position. Rows
    with more fields than the header are marked in ``_surplus_field``.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {**CSV_READ_OPTIONS, "enforceSchema": "false", "columnNameOfCorruptRecord": _RECORD}
    raw = (spark.readStream.schema(f"{schema}, `{_RECORD}` string").options(**options)
           .option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.csv").csv(folder))
    # A record is odd if it has too few fields, which is allowed, or too many.
    wider = F.from_csv(F.col(_RECORD), f"{schema}, `{SURPLUS}` string", {"quote": '"', "escape": '"'})
    marked = raw.withColumn(SURPLUS, wider[SURPLUS]).withColumn("_shard", file_shard()).drop(_RECORD)
    return null_tokens_to_null(marked, columns)


def evaluate_new_shards(stream: DataFrame, models: Sequence[Model], store: RunStore, checkpoint: str, run_id: str,
                        batch_size: int = 32, extra: Sequence[str] = ()) -> StreamingQuery:
    """Predict and store every shard not seen before, then stop.

    All batches of a call belong to the run ``run_id``. A batch that is repeated after a failure
    gets a new commit in place of the old one. Readers see nothing of it before the
    run is published, see ``finish``. Shards with a row of too many fields are left out,
    as in the batch load, and so are models that do not load at the start.
    """
    failed = load_failures(stream.sparkSession, models)
    for model, error in failed.items():
        store.fail(run_id, model, error)
    good = [m for m in models if m.key not in failed]

    def keep(batch: DataFrame, number: int) -> None:
        if SURPLUS in batch.columns:
            bad = batch.where(F.col(SURPLUS).isNotNull()).select("_shard").distinct()
            batch = batch.join(bad, "_shard", "left_anti").drop(SURPLUS)
        store.evaluate(with_row_id(normalize_input(batch), f"{number}-"), good, run_id, number, batch_size=batch_size, extra=extra)

    return (stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def finish(query: StreamingQuery, store: RunStore, run_id: str) -> None:
    """Wait for the query, raise its error if it has one, and publish the run."""
    query.awaitTermination()
    store.publish(run_id)
