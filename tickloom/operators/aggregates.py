"""Grouped measures: spreads, book costs, positions, calendars, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c
from .quantiles import quantiles


def walk_cost_bps(levels: Column, notional: float, mid: Column) -> Column:
    """Cost in basis points of taking ``notional`` through levels (array of px, sz, best first); null if they don't fill it."""
    zero = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("qty"))

    def step(a, lv):
        take = F.least(a["left"], lv["px"] * lv["sz"])
        return F.struct((a["left"] - take).alias("left"), (a["qty"] + take / lv["px"]).alias("qty"))

    return F.aggregate(levels, zero, step, lambda a: F.when(a["left"] <= 1e-9, F.abs(F.lit(float(notional)) / a["qty"] / mid - 1) * 1e4))


def impact_bps(notional: float, depth: Column, factor: float, width_bps: float) -> Column:
    """factor * notional / depth * width; null where the depth can't fill it."""
    return F.when(depth >= notional, factor * (notional / depth) * width_bps)


def effective_spread(pairs: DataFrame, keys: list[str], ask: str, bid: str, anchor: str, least: int = 5, anchors: int = 3) -> DataFrame:
    """Median of non-negative (ask - bid) / mid by key; null with too few pairs or distinct anchors."""
    x = (c(ask) - c(bid)) / ((c(ask) + c(bid)) / 2) * 1e4
    p = pairs.withColumn("e_x", F.when(x >= 0, x))
    medians = quantiles(p, keys, "e_x", {"e_m": 0.5}).select(*(F.col(k).alias(f"e_{i}") for i, k in enumerate(keys)), "n", "e_m")
    distinct = p.groupBy(*keys).agg(F.countDistinct(F.when(x >= 0, c(anchor))).alias("e_a"))
    g = distinct.join(medians, [F.col(k).eqNullSafe(F.col(f"e_{i}")) for i, k in enumerate(keys)])
    return g.select(*keys, F.when((F.col("n") >= least) & (F.col("e_a") >= anchors), F.col("e_m")).alias("spread_bps"), "n")


def range_spreads(bars: DataFrame, key: str, ts: str, step_s: int, least: int = 200, bound: float = 0.5) -> DataFrame:
    """Effective spreads, as fractions of the price, from high, low and close of pairs of bars exactly one step apart.

    Abdi and Ranaldo: 2 sqrt(max(0, mean of (c - m)(c - next m))), with c the logarithm of the close and m the middle of those of high and low.
    Corwin and Schultz: beta is the sum of both bars' squared log ranges, gamma the square of their common one, alpha weighs one against the
    other, and a pair's spread is 2 (e^alpha - 1) / (1 + e^alpha); those within ``bound`` are averaged, negative ones as zero (``inside`` counts them).
    Bars with a price that is not positive are no bars. Estimates of fewer than ``least`` pairs are null.
    """
    w, k = Window.partitionBy(key).orderBy("e_us"), 3 - 2 * math.sqrt(2)
    p = bars.where((F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))
    p = p.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("e_us"), *(F.log(x).alias(f"e_{x[0]}") for x in ("high", "low", "close")))
    p = p.select("*", *(F.lead(x).over(w).alias(f"{x}1") for x in ("e_us", "e_h", "e_l"))).where(F.col("e_us1") - F.col("e_us") == step_s * 1_000_000)
    h, l, h1, l1, close = (F.col(f"e_{x}") for x in ("h", "l", "h1", "l1", "c"))  # noqa: E741
    gamma = F.greatest(h, h1) - F.least(l, l1)
    p = p.select(key, ((close - (h + l) / 2) * (close - (h1 + l1) / 2)).alias("e_v"), ((h - l) * (h - l) + (h1 - l1) * (h1 - l1)).alias("e_b"), (gamma * gamma).alias("e_g"))
    alpha = (F.sqrt(2 * F.col("e_b")) - F.sqrt("e_b")) / k - F.sqrt(F.col("e_g") / k)
    s = F.when(F.abs("e_s") < bound, F.greatest("e_s", F.lit(0.0)))
    v = F.when(F.abs("e_v") < float("inf"), F.col("e_v"))
    p = p.withColumn("e_a", F.exp(alpha)).withColumn("e_s", 2 * (F.col("e_a") - 1) / (1 + F.col("e_a")))
    return p.groupBy(key).agg(
        F.count("*").alias("pairs"),
        F.when(F.count(v) >= least, 2 * F.sqrt(F.greatest(F.avg(v), F.lit(0.0)))).alias("abdi_ranaldo"),
        F.avg("e_b").alias("beta"),
        F.avg("e_g").alias("gamma"),
        F.count(s).alias("inside"),
        F.when(F.count(s) >= least, F.avg(s)).alias("corwin_schultz"),
    )


def upper_median(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """The value at place n / 2 of the sorted values, from 0; null below ``least`` values.

    A sketch of each key with many rows brackets the place (error 0.01 % of its rows, bracket 1 % on
    either side); rows below are counted where they lie, and only values inside are sorted.  Null
    values are left out; a null key is a key.
    """
    x = df.where(c(value).isNotNull()).select(*keys, c(value).alias("m_v"))
    edges = F.percentile_approx("m_v", [0.49, 0.51], 10_000)
    b = x.groupBy(*(F.col(k).alias(f"m_{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("n"), edges.alias("m_e"), F.min("m_v").alias("m_min"), F.max("m_v").alias("m_max"))
    many = F.col("n") >= 1_000
    b = b.withColumns({"m_lo": F.when(many, F.col("m_e")[0]).otherwise(F.col("m_min")), "m_hi": F.when(many, F.col("m_e")[1]).otherwise(F.col("m_max"))}).drop("m_e", "m_min", "m_max")
    near = x.join(b, [F.col(k).eqNullSafe(F.col(f"m_{i}")) for i, k in enumerate(keys)]).where("m_v <= m_hi")
    counts = near.groupBy(*keys, "n", F.when(F.col("m_v") >= F.col("m_lo"), F.col("m_v")).alias("m_v")).agg(F.count("*").alias("m_n"))
    upto = F.sum("m_n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("m_v")))
    found = counts.withColumn("m_upto", upto).where(F.col("m_upto") > F.floor(F.col("n") / 2))
    return found.groupBy(*keys).agg(F.min(F.when(F.col("n") >= least, F.col("m_v"))).alias("median"), F.max("n").alias("n"))


#: Keys of at most so many fills are folded in one pass.
FOLD_ROWS = 1_000_000


def position_fold(fills: DataFrame, keys: list[str], order: list[str], qty: str, price: str, *, span: Column, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Signed quantity and average price by key from ordered fills.

    Adding averages the price by weight, reducing keeps it, crossing zero starts at the fill's
    price, and a closed position has none.  Fills are counted by key first; where a key has more than
    ``fold_rows``, ``span`` (which never falls along the order, such as the day) cuts all: the fills of
    a key and span become one affine map of the price before them, and a key's maps are applied one
    after another, so that no task holds all fills of a key.  Quantities are decimals of eight
    places, so that what sums to nothing is exactly closed.  Fills without a quantity are left out.
    """
    exact = lambda q: q.cast("decimal(38,8)")
    row = F.struct(*order, exact(c(qty)).alias("q"), c(price).cast("double").alias("p"))
    f = fills.where(c(qty).isNotNull()).select(*keys, span.alias("f_span"), row.alias("f_row"))

    def step(m, fill):
        q = exact(m["q"] + fill["q"])
        adds = (m["q"] == 0) | (F.signum(m["q"]) == F.signum(fill["q"]))
        crosses = F.signum(q) != F.signum(m["q"])
        by = F.when(q == 0, 0.0).when(adds, m["q"].cast("double") / q.cast("double")).when(crosses, 0.0).otherwise(1.0)
        plus = F.when(q == 0, 0.0).when(adds, fill["q"].cast("double") * fill["p"] / q.cast("double")).when(crosses, fill["p"]).otherwise(0.0)
        return F.struct(q.alias("q"), (by * m["by"]).alias("by"), (by * m["plus"] + plus).alias("plus"))

    start = lambda before: F.struct(exact(before).alias("q"), F.lit(1.0).alias("by"), F.lit(0.0).alias("plus"))
    rows = F.array_sort(F.collect_list("f_row"))
    if not f.groupBy(*keys).count().where(F.col("count") > fold_rows).limit(1).count():
        whole = f.groupBy(*keys).agg(rows.alias("f_rows")).select(*keys, F.aggregate("f_rows", start(F.lit(0)), step).alias("m"))
        return whole.select(*keys, F.col("m.q").cast("double").alias("qty"), F.col("m.plus").alias("avg_price"))
    sums = f.groupBy(*(F.col(k).alias(f"f_{i}") for i, k in enumerate(keys)), F.col("f_span").alias("f_at")).agg(F.sum("f_row.q").alias("f_sum"))
    earlier = Window.partitionBy(*(f"f_{i}" for i in range(len(keys)))).orderBy("f_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("f_before", F.coalesce(F.sum("f_sum").over(earlier), F.lit(0))).drop("f_sum")
    parts = f.groupBy(*keys, "f_span").agg(rows.alias("f_rows"))
    parts = parts.join(sums, [F.col("f_span").eqNullSafe(F.col("f_at")), *(F.col(k).eqNullSafe(F.col(f"f_{i}")) for i, k in enumerate(keys))])
    maps = parts.select(*keys, F.struct("f_span", F.aggregate("f_rows", start(F.col("f_before")), step).alias("m")).alias("f_map"))
    whole = maps.groupBy(*keys).agg(F.array_sort(F.collect_list("f_map")).alias("f_maps"))
    return whole.select(*keys, F.element_at("f_maps", -1)["m"]["q"].cast("double").alias("qty"), F.aggregate("f_maps", F.lit(0.0), lambda p, x: x["m"]["by"] * p + x["m"]["plus"]).alias("avg_price"))


def zero_filled_days(df: DataFrame, day: str, value: Column, keys: list[str] = ()) -> DataFrame:
    """keys, day and total for every calendar day between a key's first and last, zero where none.

    A key's calendar is made from its two ends; null keys are keys, rows without a day are left out.
    """
    names = [f"z_k{i}" for i in range(len(keys))]
    sums = df.where(F.col(day).isNotNull()).groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(day).alias("z_day")).agg(value.alias("v"))
    ends = sums.groupBy(*(F.col(n).alias(f"{n}_a") for n in names)).agg(F.min("z_day").alias("a"), F.max("z_day").alias("b")).where("a is not null")
    days = ends.select(*(f"{n}_a" for n in names), F.explode(F.sequence("a", "b")).alias("day"))
    same = [F.col("day") == F.col("z_day"), *(F.col(n).eqNullSafe(F.col(f"{n}_a")) for n in names)]
    return days.join(sums, same, "left").select(*(F.col(f"{n}_a").alias(k) for n, k in zip(names, keys)), "day", F.coalesce("v", F.lit(0.0)).alias("total"))


def slices(orders: DataFrame, qty: str, parts: Column, places: int = 2) -> DataFrame:
    """Each order in equal parts rounded down; the last takes the rest."""
    q = c(qty).cast("decimal(28,6)")
    unit = F.floor(q / parts * 10**places) / 10**places
    cut = orders.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), parts)))
    return cut.withColumn("slice_qty", F.when(F.col("part") < F.col("parts"), unit).otherwise(q - unit * (F.col("parts") - 1)).cast("double"))


def stitch(series: DataFrame, names: list[str], name: str, day: str, value: str) -> DataFrame:
    """One series from aliases in order: each is rescaled at the last day it shares with what stands before, and used only after it.

    The list of aliases is short and given; each step is a join by day.
    """
    out = series.where(c(name) == names[0]).select(day, value)
    for alias in names[1:]:
        more = series.where(c(name) == alias).select(day, c(value).alias("v_new"))
        shared = out.join(more, day)
        last = shared.agg(F.max(F.struct(day, (c(value) / F.col("v_new")).alias("scale"))).alias("s")).select(F.col(f"s.{day}").alias("s_day"), "s.scale").where("scale between 0.75 and 1.25")
        added = more.crossJoin(F.broadcast(last)).where(F.col(day) > F.col("s_day")).select(day, (F.col("v_new") * F.col("scale")).alias(value))
        out = out.join(added.select(day), day, "left_anti").unionByName(added)
    return out
