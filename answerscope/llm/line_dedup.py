"""Lines known from many documents, dropped with the help of levelled sorted runs.

Each batch of documents writes one run: its line hashes, sorted, with the
number of documents that hold them. When a level has ``fanout`` runs they are
merged into one run of the next level. Lines are then merge-anti-joined with
the runs. A batch never rewrites older runs, so adding one costs its own size,
and each entry is rewritten once a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .native import apart, WHITE, ascii_lower, row_key, stored

RUN = "k1 bigint, k2 bigint, n bigint"
SALTS = 16


class LineRuns:
    """Runs of ``(k1, k2, n)`` below a folder, and a log of which are live.

    The log is a table of its own in the folder, so a later session can go on
    with the same runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.levels: dict[int, list[str]] = {}
        self.count = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = 4) -> LineRuns:
        """Go on with the runs of a folder; the log has one short row per run ever written."""
        out = cls(spark, path, fanout)
        log = spark.read.schema("run string, level int, number int, gone string").json(f"{path}/log").collect()
        gone = {x for row in log for x in (row.gone or "").split(",") if x}
        for row in sorted(log, key=lambda r: r.number):
            out.count = max(out.count, row.number + 1)
            if row.run not in gone:
                out.levels.setdefault(row.level, []).append(row.run)
        return out

    def _write(self, entries: DataFrame, level: int, gone: list[str]) -> None:
        name = f"run-{self.count:06d}"
        entries.sortWithinPartitions("k1", "k2").write.parquet(f"{self.path}/{name}")
        (self.spark.range(1).select(F.lit(name).alias("run"), F.lit(level).alias("level"), F.lit(self.count).alias("number"),
                                    F.lit(",".join(gone)).alias("gone"))
         .coalesce(1).write.mode("append").json(f"{self.path}/log"))
        self.count += 1
        for runs in self.levels.values():
            runs[:] = [r for r in runs if r not in gone]
        self.levels.setdefault(level, []).append(name)

    def entries(self, names: list[str] | None = None) -> DataFrame:
        """All entries of the live runs (or the named ones), one per key and run."""
        names = [r for level in sorted(self.levels) for r in self.levels[level]] if names is None else names
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{n}" for n in names])

    def totals(self, names: list[str] | None = None) -> DataFrame:
        return self.entries(names).groupBy("k1", "k2").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Write one batch as a run of the lowest level, then compact full levels."""
        self._write(counts.groupBy("k1", "k2").agg(F.sum("n").alias("n")), 0, [])
        level = 0
        while len(self.levels.get(level, ())) >= self.fanout:
            merged = list(self.levels[level])
            self._write(self.totals(merged), level + 1, merged)
            level += 1

    def unseen(self, lines: DataFrame, least: int = 1) -> DataFrame:
        """Lines whose key stands in fewer than ``least`` documents of the runs: a merge anti-join.

        Lines without a key stay. A line that fills the corpus is split over
        ``SALTS`` tasks; the keys of the runs are distinct and small, and are
        repeated for that.
        """
        known = self.totals().where(F.col("n") >= least).select(
            "k1", "k2", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
        salted = lines.withColumn("salt", F.pmod(F.col("r1"), F.lit(SALTS)).cast("int"))
        return salted.join(known.hint("merge"), ["k1", "k2", "salt"], "left_anti").drop("salt")


def line_keys(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per line: the row's hashes, line number, key hashes, and whether it is the key's first in its text.

    Lines with an empty key have null hashes.
    """
    def entry(line, number):
        some = line != ""
        return F.struct(F.when(some, F.xxhash64(line)).alias("k1"),
                        F.when(some, F.xxhash64(F.lit("line"), line)).alias("k2"), number.alias("line_no"))

    keys = F.transform(text_lines(F.col(text)), line_keys)
    rows = docs.select(*row_key(key, text), F.sort_array(F.transform(keys, entry)).alias("lines"))
    before = F.transform("lines", lambda x, i: F.struct(
        x["k1"].alias("k1"), x["k2"].alias("k2"), x["line_no"].alias("line_no"),
        (x["k1"].isNotNull() & ~F.struct(x["k1"], x["k2"]).eqNullSafe(
            F.struct(F.get("lines", i - 1)["k1"], F.get("lines", i - 1)["k2"]))).alias("first")))
    return rows.select("r1", "r2", F.inline(before))


def line_dedup(docs: DataFrame, least: int = 10, text: str = "text", key: str = "doc_id", batches: int = 4,
               runs: LineRuns | None = None) -> DataFrame:
    """Drop every line whose key stands in ``least`` documents or more.

    A key is the line without ASCII white space at its ends and with A-Z in
    lower case; lines split at ``\\n``; empty keys never go. Documents are
    counted batch by batch into ``runs`` (a batch is a hash of id and text;
    runs given by the caller also count what they hold already), then all lines
    are merge-anti-joined with them. Returns the input's columns and
    ``n_lines``, ``n_dropped``, ``kept_text`` (replaced if the input has them);
    null and empty texts have one empty line and keep it. Repeated rows are
    documents of their own and count so; they get the same answer. Runs several
    small jobs that write runs and the table of line hashes.
    """
    return apart(docs, [key, text], ("n_lines", "n_dropped", "kept_text"), lambda d: _without_common(d, least, text, key, batches, runs))


def _without_common(docs: DataFrame, least: int, text: str, key: str, batches: int, runs: LineRuns | None) -> DataFrame:
    spark = docs.sparkSession
    runs = runs or LineRuns(spark)
    path = f"{scratch_path(spark, 'lines')}"
    (line_rows(docs, text, key).withColumn("batch", F.pmod(F.col("r1"), F.lit(batches)).cast("int"))
     .write.partitionBy("batch").parquet(path))
    lines = spark.read.schema("r1 bigint, r2 bigint, k1 bigint, k2 bigint, line_no int, first boolean, batch int").parquet(path)
    for batch in range(batches):
        runs.add(lines.where((F.col("batch") == batch) & F.col("first")).select("k1", "k2", F.lit(1).cast("bigint").alias("n")))
    # A repeated row's lines come twice; a set of places is the same for each copy.
    kept = (runs.unseen(lines.drop("first", "batch"), least).groupBy("r1", "r2")
            .agg(F.array_distinct(F.sort_array(F.collect_list("line_no"))).alias("_places")))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(*own, *[c.alias(f"_{n}") for c, n in zip(row_key(key, text), ("r1", "r2"))])
    joined = rows.join(kept.withColumnsRenamed({"r1": "_r1", "r2": "_r2"}), ["_r1", "_r2"], "left")
    split = joined.withColumn("_lines", text_lines(F.col(text)))
    places = F.coalesce("_places", F.array().cast("array<int>"))
    return split.select(
        *own, F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(places)).cast("bigint").alias("n_dropped"),
        _pick(F.col("_lines"), places).alias("kept_text"))


def _pick(lines: Column, places: Column) -> Column:
    """The lines at some places, joined. The text is split once, whatever the optimizer puts for ``lines``."""
    return F.transform(F.array(lines), lambda once: F.array_join(F.transform(places, lambda i: F.get(once, i)), "\n"))[0]


def new_lines(docs: DataFrame, runs: LineRuns, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``line_rows`` for lines that no earlier batch has; the batch is added to the runs.

    The first result is written before the runs change, so it does not depend on them.
    """
    lines = stored(line_rows(docs, text, key), "batch-lines")
    fresh = stored(runs.unseen(lines), "new-lines")
    runs.add(lines.where("first").select("k1", "k2", F.lit(1).cast("bigint").alias("n")))
    return fresh
