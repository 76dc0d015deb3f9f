"""Exact interpolated quantiles of keys of any size.

No task holds all values of a large key: a sketch of it brackets the places asked for, rows outside
the brackets are only counted, and the values inside are counted by value where they lie.  Brackets
that still hold too many values are cut by histograms of what is in them until none does.  Keys of
few rows take Spark's own exact percentile, whose buffer they bound; both give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..sources.staging import staged

#: Keys of at most this many rows are small.
SMALL_KEY = 100_000
#: A bracket's distance from its place, and the sketch's accuracy (its error is a quarter of that distance), as shares of a key's rows.
MARGIN, ACCURACY = 1e-3, 4_000
#: Below so many rows that distance is too few rows, and the bracket is all values.
LEAST_SKETCHED = 10_000
#: Distinct values of a bracket that one task may sort, and cells of a histogram.
MOST_VALUES, CELLS = 500_000, 1_024
#: Large keys, or their brackets, up to so many are broadcast; more are joined by shuffle.
BROADCAST_BRACKETS = 100_000
_INFINITE = float("inf")


def quantiles(df: DataFrame, keys: list[str], value: str | Column, fractions: dict[str, float], *, small: int = SMALL_KEY, most_values: int = MOST_VALUES) -> DataFrame:
    """keys, n and one column for each of ``fractions``: the value at place (n - 1) * fraction, between neighbours in proportion.

    n counts values that are not null; a key without any has n 0 and null quantiles.  Null keys are
    keys; NaN is larger than all numbers; ties and repeated rows count each.  No row gives no key
    (without keys: one row of n 0).  Rows are counted by key first, then read again, and once more for
    large keys.
    """
    names, places = [f"q_k{i}" for i in range(len(keys))], list(fractions)
    x = df.select(*(c(k).alias(n) for k, n in zip(keys, names)), c(value).cast("double").alias("q_v"))
    outs = [F.col(n).alias(k) for n, k in zip(names, keys)]
    large_keys = staged(x.groupBy(*names).agg(F.count("q_v").alias("n")).where(F.col("n") > small), "quantile-large-keys")
    number = large_keys.count()
    plain = lambda rows: rows.groupBy(*names).agg(F.count("q_v").alias("n"), *(F.percentile("q_v", float(f)).alias(p) for p, f in fractions.items())).select(*outs, "n", *places)
    if not number:
        return plain(x)
    those = large_keys.select(*names, F.lit(True).alias("q_large"))
    split = _joined(x, F.broadcast(those) if number <= BROADCAST_BRACKETS else those, names, how="left")
    rest = plain(split.where("q_large is null").drop("q_large"))
    if not keys:
        rest = rest.limit(0)
    return rest.unionByName(_large(split.where(F.col("q_large") & F.col("q_v").isNotNull()).drop("q_large"), names, fractions, most_values).select(*outs, "n", *places))


def _large(x: DataFrame, names: list[str], fractions: dict[str, float], most_values: int) -> DataFrame:
    """names, n and quantiles of rows (names, q_v) of large keys."""
    places = list(fractions)
    rank = {p: (F.col("n") - 1) * F.lit(float(f)) for p, f in fractions.items()}
    shares = sorted({min(max(f + d, 0.0), 1.0) for f in fractions.values() for d in (-MARGIN, MARGIN)})
    edges = F.percentile_approx("q_v", shares, ACCURACY)
    sums = staged(x.groupBy(*names).agg(F.count("q_v").alias("n"), edges.alias("edges"), F.min("q_v").alias("low"), F.max("q_v").alias("high")), "quantile-keys")

    def bracket(p: str) -> Column:
        at = [F.element_at("edges", shares.index(min(max(fractions[p] + d, 0.0), 1.0)) + 1) for d in (-MARGIN, MARGIN)]
        # The ends of all values are exact; a sketch's are within its error.
        low = F.when((F.col("n") < LEAST_SKETCHED) | F.lit(fractions[p] <= MARGIN), F.col("low")).otherwise(at[0])
        high = F.when((F.col("n") < LEAST_SKETCHED) | F.lit(fractions[p] >= 1 - MARGIN), F.col("high")).otherwise(at[1])
        return F.struct(F.lit(p).alias("place"), F.floor(rank[p]).alias("first"), F.ceil(rank[p]).alias("last"), low.alias("low"), high.alias("high"))

    wanted = sums.select(*names, "n", F.explode(F.array(*map(bracket, places))).alias("b")).select(*names, "n", "b.*")
    wanted = staged(wanted, "quantile-brackets")
    few = wanted.count() <= BROADCAST_BRACKETS
    held = _joined(x, F.broadcast(wanted) if few else wanted, names).where("q_v <= high")
    # Values below a bracket are counted together, under null.
    counts = held.groupBy(*names, "place", "first", "last", F.when(F.col("q_v") >= F.col("low"), F.col("q_v")).alias("v")).agg(F.count("*").alias("k"))
    counts = staged(counts, "quantile-counts")
    by = Window.partitionBy(*names, "place")
    finite = F.when(F.abs("v") < _INFINITE, F.col("v"))
    # Halves, as the width of all numbers is no number.  Cells: below the bracket, minus infinity, finite values, infinity, NaN.
    width = F.col("v1") / 2 - F.col("v0") / 2
    inside = F.least(F.floor((F.col("v") / 2 - F.col("v0") / 2) / width * CELLS), F.lit(CELLS - 1)) + 1
    cell = F.when(F.col("v").isNull(), -1).when(F.col("v") == -_INFINITE, 0).when(F.isnan("v"), CELLS + 2).when(F.col("v") == _INFINITE, CELLS + 1).when(width > 0, inside).otherwise(1)
    while True:
        size = counts.where("v is not null").groupBy(*names, "place").agg(F.count("*").alias("d"), F.min(finite).alias("v0"), F.max(finite).alias("v1")).where(F.col("d") > most_values)
        large = staged(size, "quantile-large")
        if not large.count():
            break
        joined = _joined(counts, large, [*names, "place"], how="left")
        celled = staged(joined.withColumn("cell", F.when(F.col("d").isNotNull(), cell).cast("int")).drop("d", "v0", "v1"), "quantile-cells")
        sums_of = celled.where("cell is not null").groupBy(*names, "place", "first", "last", "cell").agg(F.sum("k").alias("k"))
        upto = F.sum("k").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        wide = sums_of.withColumn("upto", upto).where((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("k") <= F.col("last")))
        ends = staged(wide.groupBy(*names, "place").agg(F.min("cell").alias("cell0"), F.max("cell").alias("cell1")), "quantile-ends")
        cut = _joined(celled, ends, [*names, "place"], how="left")
        below = F.col("cell0").isNotNull() & (F.col("cell") < F.col("cell0"))
        kept = cut.where(F.col("cell1").isNull() | (F.col("cell") <= F.col("cell1")))
        counts = staged(kept.groupBy(*names, "place", "first", "last", F.when(~below, F.col("v")).alias("v")).agg(F.sum("k").alias("k")), "quantile-counts")
    upto = counts.withColumn("upto", F.sum("k").over(by.orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda at: F.min(F.when(F.col("upto") > F.col(at), F.struct("upto", "v")))["v"]
    found = upto.groupBy(*names, "place").agg(pick("first").alias("a"), pick("last").alias("b"))
    found = found.groupBy(*names).agg(*(F.max(F.when(F.col("place") == p, F.struct("a", "b"))).alias(f"q_{i}") for i, p in enumerate(places)))
    found = found.select(*(F.col(n).alias(f"{n}_f") for n in names), *(f"q_{i}" for i in range(len(places))))
    out = sums.join(found, [F.col(n).eqNullSafe(F.col(f"{n}_f")) for n in names] or F.lit(True))
    part = lambda i, p: (F.ceil(rank[p]) - rank[p]) * F.col(f"q_{i}.a") + (rank[p] - F.floor(rank[p])) * F.col(f"q_{i}.b")
    lost = F.raise_error(F.lit("a sketch was off by more than its error")).cast("double")
    between = lambda i, p: F.when(F.col(f"q_{i}.a").isNull() | F.col(f"q_{i}.b").isNull(), lost).when(F.col(f"q_{i}.a") == F.col(f"q_{i}.b"), F.col(f"q_{i}.a")).otherwise(part(i, p))
    return out.select(*names, "n", *(between(i, p).alias(p) for i, p in enumerate(places)))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null is one; the right side's keys are dropped."""
    other = right.select(*(F.col(k).alias(f"{k}_r") if k in keys else F.col(k) for k in right.columns))
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys] or F.lit(True), how).drop(*(f"{k}_r" for k in keys))
