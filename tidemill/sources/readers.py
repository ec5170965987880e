"""Sources and sinks: command logs and relations in batch or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import Scheduling
from tidemill.sources.schemas import COMMANDS, LANES

FORMATS = ("parquet", "json", "csv", "orc")


def read_commands(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A command log with the schema COMMANDS; csv can't hold `ids`, which is split at blanks."""
    _known(fmt)
    if fmt != "csv":
        return spark.read.schema(COMMANDS).format(fmt).load(path)
    flat = spark.read.schema(COMMANDS.replace("array<string>", "string")).csv(path, header=True)
    return flat.withColumn("ids", F.split("ids", " "))


def stream_commands(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A command log as a stream of files."""
    _known(fmt)
    return spark.readStream.schema(COMMANDS).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """A command log from JSON values of a Kafka topic (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.from_json(F.col("value").cast("string"), COMMANDS).alias("c")).select("c.*")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A relation of a database, read in ranges of an integer key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)


def write_relation(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Append a relation (dead letters, releases, ...) to files."""
    _known(fmt)
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def lanes_frame(spark: SparkSession, scheduling: Scheduling, order: list[str] | None = None) -> DataFrame:
    """The lanes as a relation of a few rows."""
    names = order or list(scheduling.weights)
    return spark.createDataFrame([(x, float(scheduling.weights[x]), i) for i, x in enumerate(names)], LANES)


def _known(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")
