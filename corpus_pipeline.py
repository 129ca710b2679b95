"""Corpus preparation in five stages, each one operator of ``quarry.llm``.

``STAGES`` lists (name, function).  A function takes the session, the
documents that the stage before it kept and the folder of the input tables;
its result is written as Parquet and read again as the next one's documents.
All stages but the last return the columns of ``documents``; ``n_chars``
follows the text where a stage changes it.

Edge cases are those of the operators: a null or empty text fails the quality
rules; rows that share an id or have a null one are documents of their own to
the near duplicates; extra columns are left out; an empty table stays empty
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality_rules as rules
from quarry.llm.bpe import bpe_round_trip, public_vocabulary
from quarry.llm.decontamination import decontaminate
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.stored import stored
from quarry.schemas import TABLES
from quarry.session import ensure_checkpoint_dir
from quarry.sources.ops import scratch_path
from quarry.sources.tables import read_table

COLUMNS = TABLES["documents"].fieldNames()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    ensure_checkpoint_dir(spark)
    trees = rules.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return (rules.quality_rules(docs.select(*COLUMNS), trees, keep_text=True)
            .filter("kept").select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go; documents of which nothing is left go."""
    ensure_checkpoint_dir(spark)
    cut = dedup_lines(docs.select(*COLUMNS)).filter("n_dropped < n_lines")
    return (cut.withColumn("text", F.col("kept"))
            .withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the row with the smallest id stays
    (null ids last, then the first row).  Rows are told apart by a number of
    their own, so texts that merely share an id are judged one by one."""
    ensure_checkpoint_dir(spark)
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), *COLUMNS), "near-duplicates")
    group = jaccard_components(numbered.select(F.col("number").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    stay = (numbered.select("number", "doc_id").join(group, "number")
            .groupBy("component_id").agg(F.min(order)["number"].alias("number")).select("number"))
    return numbered.join(stay, "number", "left_semi").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    ensure_checkpoint_dir(spark)
    return (decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
            .filter("n_hit = 0").select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding: token ids of every document, with digests of the ids and
    of the decoded text."""
    ensure_checkpoint_dir(spark)
    coded = bpe_round_trip(docs.select(*COLUMNS), public_vocabulary(), keep_text=False)
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.col("token_ids"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: No SQL form: trees fitted to labels decide the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
