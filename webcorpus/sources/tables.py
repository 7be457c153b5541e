"""SRC1, SRC8: readers for the given parquet tables.

Readers select the columns they need so that a projection reaches the parquet scan
(``ReadSchema``) and ``events.ts`` (``TIMESTAMP_NTZ`` on disk) is cast to
``TIMESTAMP`` for event-time functions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
CONVERSATIONS_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
SCHEMAS = {"pages": PAGES_SCHEMA, "documents": DOCUMENTS_SCHEMA, "events": EVENTS_SCHEMA,
           "conversations": CONVERSATIONS_SCHEMA}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, cast_ts: bool = True) -> DataFrame:
    """Read one given table with its declared schema (no inference pass).
    ``cast_ts=False`` keeps ``events.ts`` as wall-clock ``TIMESTAMP_NTZ``."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    if name == "events" and cast_ts:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


SCAN_PARTITIONS = "spark.webcorpus.scanPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan only when the caller asks for it: the session setting
    ``spark.webcorpus.scanPartitions`` gives the number (for small files of one row
    group, whose scan is one task). Unset, as on a cluster, tables stay as scanned;
    ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum`` size the splits."""
    asked = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(asked), key) if asked else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages"), "page_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the given tables as temp views (for SQL users and derived views)."""
    for name in names:
        path = table_path(sf_dir, name)
        if os.path.exists(path):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
