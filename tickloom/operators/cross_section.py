"""Ranks, scores and selections within a date (and bucket).

Windows are partitioned by the date, so their work spreads over dates; ties get average ranks, and
orders end with the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c


def average_rank(x, by: list[str]) -> Column:
    """Average rank, from 1, of the values that are not null."""
    x = c(x)
    w = Window.partitionBy(*by)
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x.asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2)


def rank_normalise(x, by: list[str]) -> Column:
    """2 (rank - 1) / (N - 1) - 1 with N all rows of the group; a null is 0, and so is a group of one row's -1 base."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.coalesce(2 * (average_rank(x, by) - 1) / F.greatest(n - 1, F.lit(1)) - 1, F.lit(0.0))


def percentile_score(x, by: list[str], least: int = 5, inverted: bool = False) -> Column:
    """100 (rank - 0.5) / n among the values present; 50 where they are fewer than ``least`` or the value is missing."""
    n = F.count(c(x)).over(Window.partitionBy(*by))
    s = 100 * (average_rank(x, by) - 0.5) / n
    return F.when((n < least) | c(x).isNull(), 50.0).otherwise(100 - s if inverted else s)


def zscore(x, by: list[str], clip: float) -> Column:
    w = Window.partitionBy(*by)
    s = F.stddev_samp(c(x)).over(w)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), F.when(s > 0, (c(x) - F.avg(c(x)).over(w)) / s)))


def place(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def bucketise(x, by: list[str], n: int, tie: str = "asset") -> Column:
    """n buckets from 0 by place."""
    count = F.count("*").over(Window.partitionBy(*by))
    return F.floor((place(by, c(x), F.col(tie)) - 1) * n / count).cast("int")


def top_bottom(df: DataFrame, by: list[str], x: str, n: int, tie: str = "asset") -> DataFrame:
    """Equal weights: 1 / n for the n highest, -1 / n for the n lowest."""
    high, low = place(by, F.desc(x), F.col(tie)), place(by, F.asc(x), F.col(tie))
    ranked = df.where(F.col(x).isNotNull()).withColumn("hi", high).withColumn("lo", low).where((F.col("hi") <= n) | (F.col("lo") <= n))
    return ranked.withColumn("weight", F.when(F.col("hi") <= n, 1.0 / n).otherwise(-1.0 / n)).drop("hi", "lo")


def rebalance_grid(dates: DataFrame, day: str, cadence: int, offsets: list[int]) -> DataFrame:
    """Every cadence-th date, for each starting offset (a calendar: one row for each day)."""
    numbered = dates.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)) - 1)
    return numbered.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).where(F.pmod(F.col("i") - F.col("offset"), F.lit(cadence)) == 0).where("i >= offset").select("offset", day)


def hysteresis_topk(df: DataFrame, by: list[str], rank: str, incumbent: str, retention: int, size: int) -> DataFrame:
    """Incumbents ranked within ``retention`` first, then the best others, up to ``size``."""
    first = F.col(incumbent) & (F.col(rank) <= retention)
    return df.withColumn("seat", place(by, F.when(first, 0).otherwise(1), F.col(rank))).where(F.col("seat") <= size)
