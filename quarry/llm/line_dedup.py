"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet folder of ``key`` (128-bit hash of the normalised line),
``n_docs`` (documents that hold it) and ``last`` (the largest document id
among them), sorted by the key within hash partitions.  Every batch of
documents is counted per key and merge-anti-joined with the runs: keys that no
run holds become a run of their own at level 0, so a key lies in one run only.
Keys that some run holds add a repeat file with the batch's counts.  When a
level has ``fanout`` runs they are merged into one run of the next level, and
as many repeat files into one, so a batch meets few runs however many came
before.

A line counts as repeated if its run says so already or if it has a repeat
file; only those keys are summed up and joined with the lines.  Texts are
split twice: for the keys, and for the lines to drop.

Only DataFrame operations; runs lie in the shared checkpoint folder.  A line
that a third of the documents hold is counted by document first and then
partially aggregated, and the join that drops it is a plain shuffled join
whose large partitions Spark splits.

Edge cases: a null or empty text has one empty line; a null document id
counts as one document, smaller than any id; rows that share an id are one
document to the count, and each row is cut by itself; lines under
``min_chars`` code points always stay; other columns pass through whatever
their names, and input columns named like an output are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.ops import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 4
BATCHES = 4

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else untouched; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, _UP, _LOW))


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS,
               extra: list[Column] | None = None) -> DataFrame:
    """One row per line of at least ``min_chars`` code points: the document,
    the line's position and its key's hash."""
    keys = F.transform(split_lines(F.col(text_col)), line_key)
    return (docs.select(F.col(id_col).alias("doc"), *(extra or []), F.posexplode(keys).alias("pos", "line"))
            .filter(F.char_length("line") >= min_chars)
            .withColumn("key", F.unhex(F.md5(F.col("line").cast("binary")))).drop("line"))


class LineRuns:
    """Levelled runs of one corpus under ``root``.

    The lists of runs live on the driver: one path per run."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.root = root or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/run-{self.made:06d}"
        self.made += 1
        rows.sortWithinPartitions("key").write.parquet(path)
        return path

    def _open(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All runs; a key occurs in one of them."""
        return self._open([p for level in self.levels for p in level])

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key no run holds."""
        runs = self.read()
        return rows if runs is None else rows.join(runs.select("key"), "key", "left_anti")

    def add(self, lines: DataFrame) -> None:
        """Add one batch's lines (``doc``, ``key``): new keys as a run, known
        ones as a repeat file.  The documents of a batch must not occur in
        another one."""
        once = lines.groupBy("key", "doc").agg(F.lit(1).alias("one"))
        counted = once.groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc").alias("last"))
        self.schema = counted.schema
        runs = self.read()
        if runs is None:
            self._put(0, self._write(counted))
            return
        batch = self._open([self._write(counted)])
        self.repeats.append(self._write(batch.join(runs.select("key"), "key", "left_semi")))
        if len(self.repeats) >= self.fanout:
            self.repeats = [self._merge(self.repeats)]
        self._put(0, self._write(self.unseen(batch)))

    def _put(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def _merge(self, paths: list[str]) -> str:
        return self._write(_summed(self._open(paths)))

    def common(self, min_docs: int) -> DataFrame:
        """``key``, ``n_docs`` and ``last`` of the keys that at least
        ``min_docs`` documents hold."""
        runs, repeats = self.read(), self._open(self.repeats)
        enough = F.col("n_docs") >= min_docs
        if repeats is not None:
            again = repeats.select("key")
            runs = (runs.filter(enough).unionByName(runs.filter(~enough).join(again, "key", "left_semi"))
                    .unionByName(repeats))
        return _summed(runs).filter(enough)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Every row of ``docs`` with ``n_lines`` (before dropping), ``n_dropped``
    and ``kept`` (the text of the lines that stay).  A line of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold stays
    only in the one with the largest id."""
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    batch = F.pmod(F.xxhash64(id_col), F.lit(batches))
    for b in range(batches):
        runs.add(long_lines(docs.filter(batch == b), id_col, text_col, min_chars))
    common = runs.common(min_docs).select("key", "last")

    # rows that share id and text have the same lines and lose the same ones
    same = F.xxhash64(F.coalesce(text_col, F.lit("")))
    dropped = (long_lines(docs, id_col, text_col, min_chars, [same.alias("same")])
               .join(common, "key").filter(~F.col("doc").eqNullSafe(F.col("last")))
               .groupBy("doc", "same").agg(F.collect_set("pos").alias("gone")))
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    # the input row travels as one struct, so that no name of it can clash
    rows = docs.select(F.struct(*out).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("whole"),
                       same.alias("alike"))
    got = rows.join(dropped, F.col("id").eqNullSafe(F.col("doc")) & (F.col("alike") == F.col("same")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("whole", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    return (got.withColumn("lines", split_lines(F.col("whole")))
            .select("row", F.struct(F.size("lines").cast("long").alias("n_lines"),
                                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                                    kept.alias("kept")).alias("new")).select("row.*", "new.*"))
