"""Inventory, continuity and coverage of stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

col = F.col


def content_hash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A hash by key that doesn't depend on order: rows' hashes are summed exactly, counted, and hashed."""
    values = [x for x in rows.columns if x not in keys]
    h = F.xxhash64(*values).cast("decimal(38,0)")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(*values)).alias("x"))
    return g.select(*keys, "n", F.substring(F.sha2(F.concat_ws(":", col("n").cast("string"), col("s").cast("string"), col("x").cast("string")).cast("binary"), 256), 1, 16).alias("hash"))


def adjacent(bars: DataFrame, keys: list[str], interval_s: int) -> DataFrame:
    """Add gap: |open / prior close - 1| where the prior bar is exactly one interval before, else null."""
    w = Window.partitionBy(*keys).orderBy("ts")
    seconds = F.unix_seconds(col("ts").cast("timestamp"))
    return bars.withColumn("gap", F.when(seconds - F.lag(seconds).over(w) == interval_s, F.abs(col("open") / F.lag("close").over(w) - 1)))


def spread_sample(rows: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """n rows of each bucket, spread evenly over its order."""
    w = Window.partitionBy(bucket)
    k = rows.withColumn("s_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("s_n", F.count("*").over(w))
    part = lambda i: F.floor(i * n / col("s_n"))
    return k.where((col("s_i") == 0) | (part(col("s_i")) != part(col("s_i") - 1))).drop("s_i", "s_n")


def event_recency(events: DataFrame, decision: str, kind: str, days: int) -> DataFrame:
    """Days since the last event before each decision day, and how many within ``days``; only decisions with one."""
    e = events.select("user_id", col("ts").cast("date").alias("day"), "event_type")
    n = e.where(col("event_type") == kind).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    d = e.where(col("event_type") == decision).select("user_id", "day").distinct().withColumn("ask", F.lit(1))
    both = d.join(n, ["user_id", "day"], "full_outer").withColumn("k", F.unix_date("day"))
    w = Window.partitionBy("user_id").orderBy("k")
    last = F.last(F.when(col("n") > 0, col("k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    got = both.withColumn("since", (col("k") - last).cast("int")).withColumn(f"n_{days}", F.coalesce(F.sum("n").over(w.rangeBetween(-(days - 1), -1)), F.lit(0)))
    return got.where("ask = 1 and since is not null").select("user_id", "day", "since", f"n_{days}")
