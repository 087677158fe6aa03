"""Loaders for telemetry, commands and feeds; explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import STATUS_UPDATE, TELEMETRY, TELEMETRY_JSON
from ..session import pin_utc

# Names used by other tools for the same readings.
LENIENT_NAMES = {"timestamp": "recorded_at", "lat": "pos_x", "lon": "pos_y"}


def read_table(spark: SparkSession, path: str, schema: StructType = TELEMETRY, fmt: str = "parquet",
               streaming: bool = False, **options: str) -> DataFrame:
    """Columnar or JSON files of an already typed table, as a batch or a stream."""
    pin_utc(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).options(**options).format(fmt).load(path)


def read_telemetry(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_table(spark, path, TELEMETRY, **kw)


def read_status_updates(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_table(spark, path, STATUS_UPDATE, **kw)


def read_telemetry_json(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """Files of (seq, raw, ingest_ts), where ``raw`` is the untouched request body."""
    return read_table(spark, path, TELEMETRY_JSON, "parquet", streaming, **options)


def read_telemetry_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True,
                         **options: str) -> DataFrame:
    """Request bodies from Kafka (needs the spark-sql-kafka package on the class path).

    Kafka orders per partition, so produce keyed by vehicle_id; ``seq`` interleaves the
    partitions and keeps each one's offset order.
    """
    pin_utc(spark)
    reader = spark.readStream if streaming else spark.read
    source = (
        reader.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).options(**options).load()
    )
    return source.select(
        (F.col("offset") * F.lit(65536) + F.col("partition")).alias("seq"),
        F.col("value").cast("string").alias("raw"),
        F.col("timestamp").alias("ingest_ts"),
    )


def canonical_names(df: DataFrame, names: dict[str, str] = LENIENT_NAMES) -> DataFrame:
    """Rename known foreign column names; the strict loaders never do this."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
