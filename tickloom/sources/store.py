"""A partitioned bar store whose writes are all or nothing.

Data goes to a folder of its own that nobody reads yet; one small file added to the log last makes
it the current data of the partitions it holds.  Readers look up each partition's newest entry, so
they see all of a write or nothing of it, and a writer that dies leaves the old version.  Partitions
that a write doesn't touch keep their data where it is.  Older versions can be read until their
folders are removed.  One writer at a time: a write fails if the store has moved on since it began.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import BAR_COLUMNS, BARS, upsert

PARTITION = ["interval_s", "asset"]
LOG = "version long, interval_s int, asset string, batch string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete write; 0 for a store that has none."""
    return _log(spark, path).agg(F.max("version")).first()[0] or 0


def partitions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """interval_s, asset, version and batch (folder) of every partition, as of ``version`` (the newest if not given)."""
    log = _log(spark, path)
    if version is not None:
        log = log.where(F.col("version") <= version)
    return log.groupBy(*PARTITION).agg(F.max(F.struct("version", "batch")).alias("v")).select(*PARTITION, "v.version", "v.batch")


def scan(spark: SparkSession, path: str, interval_s: int | None = None, asset: str | None = None, version: int | None = None) -> DataFrame:
    """Bars of the store (of one interval, of one asset); folders of other partitions are not listed.

    The list of partitions (one row for each instrument and interval) is read by the driver.
    """
    wanted = partitions(spark, path, version)
    if interval_s is not None:
        wanted = wanted.where(F.col("interval_s") == interval_s)
    if asset is not None:
        wanted = wanted.where(F.col("asset") == asset)
    folders = wanted.groupBy("batch", "interval_s").agg(F.collect_list("asset").alias("assets")).collect()
    if not folders:
        return spark.createDataFrame([], BARS)
    rows = spark.read.schema(BARS).option("basePath", f"{path}/data").parquet(*sorted({f"{path}/data/batch={r.batch}" for r in folders}))
    those = [(F.col("batch") == r.batch) & (F.col("interval_s") == r.interval_s) & F.col("asset").isin(r.assets) for r in folders]
    return rows.where(reduce(lambda a, b: a | b, those)).select(*BAR_COLUMNS)


def replace(bars: DataFrame, path: str, *, base: int | None = None) -> int:
    """Make ``bars`` the whole content of each partition they have rows of; returns the new version.

    ``base`` is the version that the bars were derived from, if any.  Without rows nothing changes.
    """
    spark = bars.sparkSession
    base, batch = latest_version(spark, path) if base is None else base, uuid.uuid4().hex
    bars.select(*BAR_COLUMNS).write.partitionBy(*PARTITION).parquet(f"{path}/data/batch={batch}")
    written = spark.read.schema(BARS).parquet(f"{path}/data/batch={batch}").select(*PARTITION).distinct()
    if latest_version(spark, path) != base:
        raise RuntimeError(f"the store has moved on from version {base}")
    _publish(written.select(F.lit(base + 1).cast("long").alias("version"), *PARTITION, F.lit(batch).alias("batch")), path)
    return latest_version(spark, path)


def _publish(entries: DataFrame, path: str) -> None:
    """Add the entries as one file, which appears by one rename."""
    entries.coalesce(1).write.mode("append").json(f"{path}/log")


def merge(new: DataFrame, path: str) -> int:
    """Upsert bars by (interval_s, asset, ts_utc): only partitions with new rows are read, and all of them change at once."""
    spark = new.sparkSession
    base = latest_version(spark, path)
    touched = new.select(*PARTITION).distinct()
    old = scan(spark, path, version=base).join(touched, PARTITION, "left_semi")
    merged = upsert(old, new.select(*BAR_COLUMNS), [*PARTITION, "ts_utc"])
    return replace(merged.select(*BAR_COLUMNS), path, base=base)
