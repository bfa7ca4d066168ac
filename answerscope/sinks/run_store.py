"""Stored runs: parts written by themselves, published together, with mergeable states beside them.

Below the folder of a store lie

* ``rows``: the predictions, one folder per attempt; the rows of all models lie as they come, so the texts
  of an input, which each of its rows repeats, are kept about once. Parquet bloom filters on the
  pair's key let a look-up of a few pairs skip almost all row groups;
* ``answers``: how often each answer of each model was given to each pair, bucketed by pair,
  so that agreement and disagreement aggregate without an exchange;
* ``scores`` and ``cells``: counted scores, and sums with sketches per model and band;
* ``log``: one small JSON file per entry, only ever added to.

A part is what one batch holds of one model. Its entry is written after its rows and
states, and a run's entry, which lists the parts it consists of, after all of them. Readers start from
the newest entry of a run, so they see whole runs only, and an attempt that was repeated
or given up is never read. Nothing is renamed, replaced or deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.keys import PAIR_KEY, ROW_KEY, answer_key, pair_of
from ..operators import disagreement, metrics
from ..operators.predict import Model, fan_out
from ..session import REPEATED_TEXTS
from ..sources.results import RUN_ID_PATTERN, ordered_projection

LOG = ("run_id string, kind string, at timestamp, batch int, attempt string, model string, rows bigint, error string, buckets int, "
       "columns string, parts array<struct<batch: int, attempt: string, model: string, rows: bigint>>")
BEGIN, PART, FAILURE, RUN = "begin", "part", "failure", "run"


# Texts in dictionaries; the pair's key is in none, so that it always has its bloom filter.
ROW_FILES = {**REPEATED_TEXTS, f"parquet.enable.dictionary#{PAIR_KEY}": "false", f"parquet.bloom.filter.enabled#{PAIR_KEY}": "true"}


class RunStore:
    """Runs below one folder. Writing and publishing run jobs; ``read`` and the aggregates are lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._begun = spark, folder.rstrip("/"), set()

    # --- the log -------------------------------------------------------------

    def log(self) -> DataFrame:
        """All entries; an empty table for a store without any."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.folder}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def _add(self, entries: Sequence[dict]) -> None:
        names = StructType.fromDDL(LOG).names
        rows = [tuple(e.get(n) for n in names) for e in entries]
        # One file, put in place as a whole.
        stamped = self.spark.createDataFrame(rows, LOG).withColumn("at", F.current_timestamp())
        stamped.coalesce(1).write.mode("append").json(f"{self.folder}/log")

    def _begin(self, run_id: str) -> None:
        """Note that this object writes to the run; from then on there is a log."""
        if run_id not in self._begun:
            self._add([{"run_id": run_id, "kind": BEGIN}])
            self._begun.add(run_id)

    def latest(self) -> str | None:
        """The highest published run id of the usual form; opens no data file."""
        runs = self.log().where((F.col("kind") == RUN) & F.col("run_id").rlike(RUN_ID_PATTERN))
        return runs.agg(F.max("run_id")).first()[0]

    def runs(self) -> DataFrame:
        """Published runs: ``run_id, at, batches, models, rows``."""
        newest = self.log().where(F.col("kind") == RUN).groupBy("run_id").agg(F.max_by("parts", "at").alias("p"), F.max("at").alias("at"))
        count = lambda c: F.size(F.array_distinct(F.col("p")[c]))
        return newest.select("run_id", "at", count("batch").alias("batches"), count("model").alias("models"),
                             F.aggregate("p", F.lit(0).cast("bigint"), lambda a, p: a + p["rows"]).alias("rows"))

    def failures(self, run_id: str) -> DataFrame:
        """Models left out of a run: ``model, batch, error``, the first failure of each."""
        mine = self.log().where((F.col("run_id") == run_id) & (F.col("kind") == FAILURE))
        return mine.groupBy("model").agg(F.min_by(F.struct("batch", "error"), "at").alias("f")).select("model", "f.batch", "f.error")

    def _published(self, run_id: str | None):
        chosen = run_id or self.latest()
        entry = self.log().where((F.col("kind") == RUN) & (F.col("run_id") == chosen)).orderBy(F.desc("at")).first() if chosen else None
        if entry is None:
            raise LookupError(f"no published run {run_id or ''} in {self.folder}")
        return entry

    # --- writing -----------------------------------------------------------------

    def write(self, predictions: DataFrame, run_id: str, models: Sequence[str], batch: int = 0, buckets: int | None = None) -> dict[str, str]:
        """Write one batch of a run and commit its models one by one; returns the messages of those that failed.

        ``predictions`` are the rows of the named models, all in one job. Where the column ``model_error`` is set, the
        model has failed in a task: none of its rows in this batch is committed, and ``publish`` will leave
        the model out of the run. ``buckets``, by default the number of shuffle
        partitions, are those of the run's first batch.
        """
        self._begin(run_id)
        spark, attempt = self.spark, uuid.uuid4().hex
        first = self.log().where((F.col("run_id") == run_id) & (F.col("kind") == PART)).agg(F.min_by("buckets", "at")).first()[0]
        buckets = first or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if "model_error" not in predictions.columns:
            predictions = predictions.withColumn("model_error", F.lit(None).cast("string"))
        # Counted while the rows are written: per model the rows and a message of failure.
        seen, mine = Observation(), [F.col("model") == m for m in models]
        watched = predictions.observe(seen, F.count(F.lit(1)).alias("all"),
                                      *[F.count_if(is_mine).alias(f"n{i}") for i, is_mine in enumerate(mine)],
                                      *[F.max(F.when(is_mine, F.col("model_error"))).alias(f"e{i}") for i, is_mine in enumerate(mine)])
        keyed = watched.where(F.col("model_error").isNull()).withColumn(PAIR_KEY, pair_of(watched))
        rows = ordered_projection(keyed, PAIR_KEY, *([ROW_KEY] if ROW_KEY in keyed.columns else [])).withColumns(
            {"run_id": F.lit(run_id), "batch": F.lit(batch)})
        path = f"{self.folder}/rows/{run_id}/{attempt}"
        rows.write.options(**ROW_FILES).parquet(path)

        found = seen.get
        if found["all"] != sum(found[f"n{i}"] for i in range(len(models))):
            raise ValueError(f"rows of models that are not among {list(models)}")
        failed = {m: found[f"e{i}"] for i, m in enumerate(models) if found[f"e{i}"] is not None}
        good = {m: found[f"n{i}"] for i, m in enumerate(models) if m not in failed}
        filled = [m for m, n in good.items() if n]
        if filled:
            self._write_states(self._of_models([path], filled, rows.schema), run_id, attempt, buckets)
        entry = {"run_id": run_id, "batch": batch, "attempt": attempt}
        self._add([*[{**entry, "kind": PART, "model": m, "rows": n, "buckets": buckets, "columns": rows.schema.json()} for m, n in good.items()],
                   *[{**entry, "kind": FAILURE, "model": m, "error": e} for m, e in failed.items()]])
        return failed

    def evaluate(self, inputs: DataFrame, models: Sequence[Model], run_id: str, batch: int = 0, **options) -> dict[str, str]:
        """Run the models over the inputs and write the batch; returns the messages of the models that failed.

        All models share one job. One that cannot be loaded where a task runs is tried on
        other executors, then given up alone; nothing of the others is computed again. If
        the job itself is lost, say because a model takes the Python worker down, every model
        gets a job of its own; if none of these ends well, the error is raised. Models that failed in
        an earlier batch of the run are not tried.
        """
        self._begin(run_id)
        lost = {r.model for r in self.failures(run_id).collect()}
        models = [m for m in models if m.key not in lost]
        if not models:
            return {}
        try:
            return self._evaluated(inputs, models, run_id, batch, options)
        except (PySparkException, Py4JError) as e:
            if len(models) == 1:
                raise
            failed, broken, first = {}, {}, e
        for m in models:
            try:
                failed |= self._evaluated(inputs, [m], run_id, batch, options)
            except (PySparkException, Py4JError) as e:
                broken[m.key] = str(e).strip().splitlines()[0][:500]
        if len(broken) == len(models):
            raise first  # the inputs or the cluster, not a model
        for model, message in broken.items():
            self.fail(run_id, model, message, batch)
        return failed | broken

    def _evaluated(self, inputs: DataFrame, models: Sequence[Model], run_id: str, batch: int, options: dict) -> dict[str, str]:
        # Once a row of input, not of output.
        keyed = inputs.withColumn(PAIR_KEY, pair_of(inputs))
        raw = fan_out(keyed, models, retry_load=True, annotate=True, **options)
        return self.write(raw, run_id, [m.key for m in models], batch)

    def fail(self, run_id: str, model: str, error: str, batch: int = 0) -> None:
        """Record that a model gave nothing, so that ``publish`` leaves it out."""
        self._add([{"run_id": run_id, "kind": FAILURE, "batch": batch, "model": model, "error": error}])

    def _write_states(self, rows: DataFrame, run_id: str, attempt: str, buckets: int) -> None:
        """States of the rows just written; no text but the answers is read."""
        cells = metrics.score_cells(rows).withColumn("attempt", F.lit(attempt))
        cells.coalesce(1).write.parquet(f"{self.folder}/cells/{run_id}/{attempt}")
        scores = rows.where("score is not null").groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
        # Sorted, so that a bracket of scores is found in few row groups.
        (scores.repartitionByRange("model", "score").sortWithinPartitions("model", "score")
         .write.parquet(f"{self.folder}/scores/{run_id}/{attempt}"))
        # Counted before they meet by pair, so a pair with very many rows arrives as its distinct answers.
        answers = (rows.groupBy(F.col(PAIR_KEY).alias("_pair"), answer_key(F.col("answer")).alias("_answer"), "model")
                   .agg(F.count(F.lit(1)).alias("_rows")).withColumn("attempt", F.lit(attempt)))
        name = self._answers_table(run_id, buckets)
        (answers.repartition(buckets, "_pair").select(*self.spark.table(name).columns)
         .write.mode("append").format("parquet").bucketBy(buckets, "_pair").sortBy("_pair").saveAsTable(name))

    def _answers_table(self, run_id: str, buckets: int) -> str:
        """The catalog's name of the bucketed answers of a run; the files are the store's own."""
        location = f"{self.folder}/answers/{run_id}"
        name = "answers_" + hashlib.md5(location.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} (_pair binary, _answer binary, model string, _rows bigint, attempt string) using parquet "
                           f"clustered by (_pair) sorted by (_pair) into {buckets} buckets location '{location}'")
        return name

    def publish(self, run_id: str) -> None:
        """Make the run visible as it stands: of every batch and model the newest commit, models with a failure left out whole."""
        mine = self.log().where(F.col("run_id") == run_id)
        failed = mine.where(F.col("kind") == FAILURE).select("model").distinct()
        parts = mine.where(F.col("kind") == PART).join(failed, "model", "left_anti")
        newest = parts.groupBy("batch", "model").agg(F.max_by(F.struct("attempt", "rows", "buckets", "columns"), "at").alias("p"))
        rows = newest.select("batch", "p.attempt", "model", "p.rows", "p.buckets", "p.columns").orderBy("batch", "model").collect()
        if not rows:
            raise LookupError(f"no complete model in run {run_id}")
        self._add([{"run_id": run_id, "kind": RUN, "buckets": rows[0].buckets, "columns": rows[0].columns,
                    "parts": [(r.batch, r.attempt, r.model, r.rows) for r in rows]}])

    # --- reading -----------------------------------------------------------------

    def read(self, run_id: str | None = None) -> DataFrame:
        """The rows of a published run, by default the latest, with ``run_id`` and ``batch``."""
        return self._rows(self._published(run_id))

    def _rows(self, entry) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["columns"]))
        models, paths = {}, {}
        for p in entry.parts:
            if p.rows:
                models.setdefault(p.attempt, []).append(p.model)
        for attempt, published in models.items():
            paths.setdefault(tuple(sorted(published)), []).append(f"{self.folder}/rows/{entry.run_id}/{attempt}")
        # Listed by name, so nothing but the published attempts is opened or even listed; one scan, unless
        # attempts differ in the models that are published of them.
        scans = [self._of_models(mine, published, schema) for published, mine in paths.items()]
        return reduce(DataFrame.unionByName, scans) if scans else self.spark.createDataFrame([], schema)

    def _of_models(self, paths: Sequence[str], models: Sequence[str], schema: StructType) -> DataFrame:
        """The models' rows below the folders; those of others, say of a model that failed in some tasks, are passed over.

        Runs of before lie in one folder per model, whose name is no column of theirs.
        """
        return self.spark.read.schema(schema).parquet(*paths).where(F.col("model").isin(list(models))).select(*schema.names)

    def _state(self, entry, kind: str) -> DataFrame | None:
        models = [p.model for p in entry.parts]
        paths = [f"{self.folder}/{kind}/{entry.run_id}/{a}" for a in dict.fromkeys(p.attempt for p in entry.parts if p.rows)]
        return self.spark.read.parquet(*paths).where(F.col("model").isin(models)) if paths else None

    def answer_counts(self, run_id: str | None = None) -> DataFrame:
        """Published counts ``_pair, _answer, model, _rows``, bucketed by pair."""
        entry = self._published(run_id)
        name = self._answers_table(entry.run_id, entry.buckets)
        self.spark.catalog.refreshTable(name)
        attempts = list(dict.fromkeys(p.attempt for p in entry.parts))
        return self.spark.table(name).where(F.col("attempt").isin(attempts) & F.col("model").isin([p.model for p in entry.parts])).drop("attempt")

    def agreement_groups(self, run_id: str | None = None) -> DataFrame:
        """As ``metrics.agreement_groups`` of the run's rows, from the counts."""
        return metrics.agreement_of_counts(self.answer_counts(run_id))

    def disagreement(self, run_id: str | None = None) -> DataFrame:
        """As ``disagreement.disagreement`` of the run's rows, from the counts."""
        models = {p.model for p in self._published(run_id).parts}
        return disagreement.disagreement_of_counts(self.answer_counts(run_id), sorted(models))

    def metrics_document(self, run_id: str | None = None) -> DataFrame:
        """As ``metrics.metrics_document`` of the run's rows, from the states of its batches."""
        entry = self._published(run_id)
        cells = self._state(entry, "cells")
        if cells is None:
            return metrics.metrics_document(self._rows(entry))
        agreement = self.agreement_groups(entry.run_id).agg(F.coalesce(F.avg("n_unique_answers"), F.lit(0.0)).alias("avg_unique_answers"))
        return metrics.document_of(cells, self._state(entry, "scores"), agreement, weight="n")
