"""Structured Streaming: resampling, flow, deduplication, deliveries, strict JSON sources and sinks with side tables.

Event times are TIMESTAMP; rows later than the watermark are dropped by Spark.  A restarted query
goes on from its checkpoint.  State is kept by key and is small: a position, a hold, a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.staging import shared_path
from .stateful import PROVIDER

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """The events as a stream of files, with an event time and a watermark."""
    rows = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and stop; results and checkpoint are written to the shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def resample(stream: DataFrame, key: str, price: str, width: str) -> DataFrame:
    """Bars of closed windows; a window closes once the watermark passes its end."""
    w = F.window("ts", width)
    order = F.struct("ts", "event_id")
    return stream.groupBy(w.alias("w"), key).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("n")).select(key, F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def flow_minute(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n_trades"), F.sum("value").alias("notional")).select(key, F.col("w.start").alias("minute"), "n_trades", "notional")


def dedupe(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- deliveries and sinks


def time_slices(rows: DataFrame, ts: str, n: int = 3) -> DataFrame:
    """Add ``slice`` (0 to n - 1): which of ``n`` equal spans of all times the row's lies in."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(us).alias("a"), F.max(us).alias("z")).first()
    low, width = ends["a"] or 0, (ends["z"] or 0) - (ends["a"] or 0) + 1
    return rows.withColumn("slice", F.floor((us - F.lit(low)) * n / F.lit(width)).cast("int"))


def run_deliveries(deliveries: list[DataFrame], work: Callable[[DataFrame], DataFrame], name: str, *, ts: str = "ts", watermark: str = "1 hour", late: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Hand ``deliveries`` to the stream one after another; each is taken up by a query that restarts from the checkpoint of the last.

    Returns the rows written, and where ``late`` names a boolean column, the rows it marks, which go
    to a table of their own.  Each micro-batch overwrites the folder of its own number, so one that
    is run again after a failure writes nothing twice.
    """
    spark, path = deliveries[0].sparkSession, shared_path(deliveries[0].sparkSession, name)
    schema = deliveries[0].schema
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{path}/in")
        stream = work(spark.readStream.schema(schema).parquet(f"{path}/in").withWatermark(ts, watermark))

        def write(batch: DataFrame, number: int) -> None:
            if late is None:
                batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
                return
            kept = batch.persist()
            kept.where(F.col(late)).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            kept.where(~F.col(late)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            kept.unpersist()

        start_and_wait(stream, write, f"{path}/checkpoint")
    out = lambda kind: spark.read.schema(stream.schema).parquet(f"{path}/{kind}").select(stream.columns)
    return out("out"), out("late") if late else None


def start_and_wait(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there and stop.

    State is in RocksDB, in no more partitions than the cluster has cores (each keeps a worker busy in
    every micro-batch; a checkpoint keeps its number).  The session's own settings are put back.
    """
    spark, partitions = stream.sparkSession, "spark.sql.shuffle.partitions"
    before = {key: spark.conf.get(key) for key in (PROVIDER[0], partitions)}
    spark.conf.set(*PROVIDER)
    spark.conf.set(partitions, str(min(int(before[partitions]), spark.sparkContext.defaultParallelism)))
    try:
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def json_stream(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """JSON lines of a folder as a stream, each with its text (``raw``) and what is wrong with it (``reason``; null: nothing).

    A line that isn't JSON of this schema is 'malformed'; one that lacks a field, or has it null, is 'incomplete'.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    rows = spark.readStream.options(**options).text(path).where(F.trim("value") != "")
    parsed = rows.select(F.col("value").alias("raw"), F.from_json("value", f"{schema}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("row"))
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f"row.{f}").isNull()
    reason = F.when(F.col("row").isNull() | F.col("row.broken").isNotNull(), "malformed").when(missing, "incomplete")
    return parsed.select(*(F.col(f"row.{f}").alias(f) for f in fields), "raw", reason.alias("reason"))


def quarantined(stream: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write a :func:`json_stream`: good rows to path/good, the others with raw text and reason to path/bad; returns both tables.

    Called again on the same path, it goes on from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where("reason is not null").select("raw", "reason").write.mode("overwrite").parquet(f"{path}/bad/batch={number}")
        batch.where("reason is null").drop("raw", "reason").write.mode("overwrite").parquet(f"{path}/good/batch={number}")

    start_and_wait(stream, write, f"{path}/checkpoint")
    good = [f for f in stream.schema.fields if f.name not in ("raw", "reason")]
    read = stream.sparkSession.read
    return read.schema(StructType(good)).parquet(f"{path}/good").drop("batch"), read.schema("raw string, reason string").parquet(f"{path}/bad").drop("batch")
