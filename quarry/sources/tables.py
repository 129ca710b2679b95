"""Typed table scans (op 1) and the shared-store conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one table with its declared schema.

    Filters and projections applied later are pushed into the Parquet scan by
    Catalyst (``PushedFilters`` / ``ReadSchema`` in the plan).
    """
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, name: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None,
              fetch_size: int = 10_000) -> DataFrame:
    """Op 1 over JDBC (the shared store of the reference is a relational
    database): ``num_partitions`` parallel range reads on
    ``partition_column``, the declared schema of table ``name`` imposed with
    ``customSchema``; later filters and projections are pushed into the
    database queries by Spark's JDBC source."""
    schema = TABLES[name]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema.fields)
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("partitionColumn", partition_column).option("lowerBound", lower)
         .option("upperBound", upper).option("numPartitions", num_partitions)
         .option("fetchsize", fetch_size).option("customSchema", ddl))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load().select(*schema.fieldNames())


class Tables:
    """Lazy accessor: ``Tables(spark, root).orders`` is a typed scan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.root, name)
