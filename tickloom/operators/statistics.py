"""Evaluation statistics, cost curves and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c
from .cross_section import average_rank

col = F.col


def rank_ic(df: DataFrame, by: list[str], x: str, y: str, least: int) -> DataFrame:
    """Correlation of average ranks by group with at least ``least`` rows."""
    k = df.select(*by, average_rank(x, by).alias("a"), average_rank(y, by).alias("b"))
    return k.groupBy(*by).agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n")).where(col("n") >= least)


def ic_summary(ic: DataFrame, overlap: float) -> DataFrame:
    """Mean, deviation, t with periods deflated by the overlap, share above zero."""
    t = F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic") / overlap)
    return ic.agg(F.count("ic").alias("periods"), (F.round(F.avg("ic"), 6) + 0.0).alias("mean"), F.round(F.stddev_samp("ic"), 6).alias("std"), (F.round(t, 6) + 0.0).alias("t"), F.round(F.avg((col("ic") > 0).cast("int")), 6).alias("hit"))


def nav_metrics(df: DataFrame, ts: str, r: str, per_year: float) -> DataFrame:
    """Return, growth, deviation, Sharpe and drawdown of one series (one row a day: a small ordered table)."""
    w = Window.orderBy(ts)
    n = df.withColumn("nav", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("dd", col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    last = F.max_by("nav", ts)
    return n.agg(F.count("*").alias("steps"), F.round(last - 1, 6).alias("total_return"), F.round(F.pow(last, F.lit(per_year) / F.count("*")) - 1, 6).alias("cagr"), F.round(F.stddev_samp(r) * F.sqrt(F.lit(per_year)), 6).alias("vol"), F.round(F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(per_year)), 6).alias("sharpe"), (F.round(F.min("dd"), 6) + 0.0).alias("max_drawdown"), (F.count("*") < 60).alias("insufficient"))


def benchmark_compare(df: DataFrame, r: str, b: str, per_year: float) -> DataFrame:
    a, y = c(r) - c(b), F.lit(per_year)
    return df.where(c(b).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(a) * y, 6).alias("active"), F.round(F.stddev_samp(a) * F.sqrt(y), 6).alias("tracking"), F.round(F.avg(a) / F.stddev_samp(a) * F.sqrt(y), 6).alias("information_ratio"), F.round(F.corr(r, b), 6).alias("correlation"), F.round(F.covar_pop(r, b) / F.var_pop(b), 6).alias("beta"))


def blocks(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Equal consecutive blocks of one ordered series."""
    return df.withColumn("block", F.floor((F.row_number().over(Window.orderBy(ts)) - 1) * n / F.count("*").over(Window.partitionBy())).cast("int"))


def longest_run(df: DataFrame, ts: str, flag: str) -> DataFrame:
    """Width and ends of the longest run of rows on which the flag holds (the earliest of equals)."""
    i = F.row_number().over(Window.orderBy(ts)) - F.row_number().over(Window.partitionBy(flag).orderBy(ts))
    runs = df.withColumn("island", i).where(flag).groupBy("island").agg(F.count("*").alias("width"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return runs.orderBy(F.desc("width"), "first").limit(1).select("width", "first", "last")


def drawn(*parts) -> Column:
    """A number below 2**32, spread evenly: the first 32 bits of MD5 of the parts as text."""
    text = F.concat_ws(":", *(c(x).cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def block_bootstrap(df: DataFrame, ts: str, r: str, b: str, iterations: int, block: int, seed: int = 17) -> DataFrame:
    """Paired circular block resample of the difference of Sharpe ratios: quantiles and share above zero.

    Each iteration draws starts from MD5 of seed, iteration and place; days come by an equi-join on their number.
    """
    x = df.where(c(b).isNotNull()).withColumn("i", F.row_number().over(Window.orderBy(ts)) - 1)
    n = x.agg(F.count("*").alias("n"))
    draws = df.sparkSession.range(iterations).withColumnRenamed("id", "it").join(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(col("n") / block).cast("int") - 1)))
    days = draws.withColumn("start", F.pmod(drawn(F.lit(seed), "it", "k"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(col("k") * block + col("j") < col("n")).select("it", F.pmod(col("start") + col("j"), "n").cast("int").alias("i"))
    sharpe = lambda v: F.avg(v) / F.stddev_samp(v)
    per = days.join(x, "i").groupBy("it").agg((sharpe(r) - sharpe(b)).alias("d"))
    return per.agg(F.count("*").alias("iterations"), F.round(F.percentile("d", 0.05), 6).alias("p05"), F.round(F.percentile("d", 0.5), 6).alias("p50"), F.round(F.percentile("d", 0.95), 6).alias("p95"), F.round(F.avg((col("d") > 0).cast("int")), 6).alias("positive"))


def permutation_null(df: DataFrame, ts: str, id: str, x: str, y: str, seeds: int) -> DataFrame:
    """Mean rank IC of drawn permutations of the outcomes within dates, beside the actual one (seed -1).

    Ranks don't depend on the order, so they are taken once; each seed only deals the outcomes' ranks out anew.
    """
    k = df.select(ts, id, average_rank(x, [ts]).alias("a"), average_rank(y, [ts]).alias("b"))
    many = k.select(ts, id, "b", F.explode(F.sequence(F.lit(-1), F.lit(seeds - 1))).alias("seed"))
    order = F.when(col("seed") < 0, F.lit(0)).otherwise(drawn("seed", id))
    dealt = many.select("seed", ts, "b", F.row_number().over(Window.partitionBy("seed", ts).orderBy(order, id)).alias("p"))
    fixed = k.select(ts, "a", F.row_number().over(Window.partitionBy(ts).orderBy(id)).alias("p"))
    ic = dealt.join(fixed, [ts, "p"]).groupBy("seed", ts).agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n")).where("n >= 10")
    return ic.groupBy("seed").agg(F.count("ic").alias("dates"), (F.round(F.avg("ic"), 6) + 0.0).alias("mean_ic"))


def phase_combine(df: DataFrame, phase: str, ts: str, nav: str, phases: int) -> DataFrame:
    """Mean of the phases on the days they share, each rebased to 1 at the first of them."""
    common = df.groupBy(ts).agg(F.count("*").alias("k")).where(col("k") == phases).select(ts)
    k = df.join(common, ts).withColumn("v", c(nav) / F.first(nav).over(Window.partitionBy(phase).orderBy(ts)))
    return k.groupBy(ts).agg(F.round(F.avg("v"), 6).alias("nav"))


def sqrt_impact(notional: Column, volume: Column, vol: Column, coefficient: float) -> Column:
    """coefficient * sqrt(participation) * vol in basis points; 10,000 where the volume is unknown."""
    return F.when(volume > 0, coefficient * F.sqrt(notional / volume) * vol * 1e4).otherwise(10_000.0)


def allocate(df: DataFrame, by: str, proposed: Column, side: float, gross: float, least: float) -> DataFrame:
    """Proposed signed weights scaled down to the side and gross budgets, small ones dropped."""
    a = df.withColumn("w", proposed)
    b = a.withColumn("w", col("w") * F.least(F.lit(1.0), side / F.sum(F.abs("w")).over(Window.partitionBy(by, F.signum("w"))))).where("w <> 0")
    d = b.withColumn("w", col("w") * F.least(F.lit(1.0), gross / F.sum(F.abs("w")).over(Window.partitionBy(by))))
    return d.where(F.abs("w") >= least)


def two_factor_residual(bars: DataFrame, n: int) -> DataFrame:
    """Deviation of the residuals of r1 on the market and on (first sector - market), closed form, n full rows."""
    market = bars.groupBy("ts").agg(F.avg("r1").alias("a"), F.avg(F.when(col("asset").isin("P1", "P2"), col("r1"))).alias("h"))
    j = bars.join(market, "ts").select("asset", "ts", col("r1").alias("y"), "a", (col("h") - col("a")).alias("b")).where("y is not null and b is not null")
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(-(n - 1), 0)
    v = lambda p, q: F.covar_pop(p, q).over(w)
    aa, bb, ab, ya, yb = v("a", "a"), v("b", "b"), v("a", "b"), v("y", "a"), v("y", "b")
    p = j.select("asset", "ts", F.count("*").over(w).alias("n"), v("y", "y").alias("yy"), aa.alias("aa"), bb.alias("bb"), ab.alias("ab"), ya.alias("ya"), yb.alias("yb")).withColumn("det", col("aa") * col("bb") - col("ab") * col("ab"))
    fit = (col("ya") * col("ya") * col("bb") - 2 * col("ya") * col("yb") * col("ab") + col("yb") * col("yb") * col("aa")) / col("det")
    return p.select("asset", "ts", F.round(F.when((col("n") == n) & (col("det") > 1e-12), F.sqrt(F.greatest(col("yy") - fit, F.lit(0.0)))), 4).alias("idio"))
