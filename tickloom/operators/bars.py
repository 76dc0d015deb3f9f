"""Bars from ticks and from finer bars, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import c


def resample_ohlcv(ticks: DataFrame, keys: list[str], bucket: Column, price: str, tie: list[str], volume: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume, quote_volume and trades by key and bucket; ``tie`` orders the ticks.

    One aggregation with partial results before the shuffle.  Ticks without a price are counted, but neither open nor close a bar.
    """
    order = F.when(c(price).isNotNull(), F.struct(*tie))
    return ticks.groupBy(*keys, bucket.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(F.lit(1.0) if volume is None else volume).alias("volume"),
        F.sum(price).alias("quote_volume"),
        F.count("*").alias("trades"),
    )


def coarser(bars: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Bars of a coarser grid."""
    return bars.groupBy(*keys, bucket.alias("bucket")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"))


def violation(asset="asset") -> Column:
    """Why a bar is invalid, or null: id, prices, volume, order of prices."""
    prices = [c(x) for x in ("open", "high", "low", "close")]
    bad = F.lit(False)
    for p in prices:
        bad = bad | p.isNull() | F.isnan(p) | (p <= 0) | (p == float("inf"))
    inside = (c("low") <= F.least("open", "close")) & (c("high") >= F.greatest("open", "close"))
    return F.when(~c(asset).rlike("^[A-Z0-9]{1,20}$") | c(asset).isNull(), "asset").when(bad, "price").when(c("volume").isNull() | (c("volume") < 0), "volume").when(~inside, "range")


def split_valid(bars: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid bars, and the others with their reason."""
    marked = bars.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; raises if a key repeats."""
    if not duplicates(rows, keys).isEmpty():
        raise ValueError(f"duplicate rows by {', '.join(keys)}")
    return rows


def validate_selection(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns; raises for one that is missing or named twice."""
    missing, twice = [w for w in wanted if w not in df.columns], {w for w in wanted if wanted.count(w) > 1}
    if missing or twice:
        raise ValueError(f"missing {missing}, named twice {sorted(twice)}")
    return wanted
