"""Readers and writers: parquet, SQL text, typed CSV, JDBC and managed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLOT_TABLES = {"HOTEL": "slot_facts_hotel", "CLIENT": "slot_facts_client"}
JDBC_BATCH = 16000


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """One parquet table of a folder, narrowed to the columns asked for."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return table.select(*columns) if columns else table


def read_slots(spark: SparkSession, model: str, folder: str | None = None) -> DataFrame:
    """Slot facts of a model, from the catalog or from a folder holding one parquet set per model."""
    name = SLOT_TABLES[model]
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}") if folder else spark.table(name)


def run_query(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """Run SQL text; ``:name`` markers are bound as typed literals."""
    return spark.sql(text, args=values) if values else spark.sql(text)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and declared column types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Save a frame as parquet, one folder per value of ``partition_by``."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish_table(frame: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a catalog table; ``path`` puts its files outside the warehouse folder."""
    writer = frame.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_jdbc(spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a warehouse query; pass partitionColumn, bounds and numPartitions to read in parallel."""
    source = {"dbtable": f"({query}) src"} if options and "partitionColumn" in options else {"query": query}
    return spark.read.format("jdbc").options(url=url, **source, **(options or {})).load()


def publish_jdbc(frame: DataFrame, url: str, name: str, options: Mapping[str, str] | None = None) -> None:
    """Replace a warehouse table, written in batches from every partition."""
    writer = frame.write.mode("overwrite").format("jdbc").option("batchsize", JDBC_BATCH)
    writer.options(url=url, dbtable=name, **(options or {})).save()
