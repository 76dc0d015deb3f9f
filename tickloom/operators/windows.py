"""Trailing features as columns over ordered windows of a key.

``full(n)`` nulls a value unless the window holds n rows; ``clean(n, x)`` unless all n values of x
are present; ``at_least(k, n, x)`` unless k are.  Aggregates alone would skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c


class Trailing:
    """Windows of one key and order."""

    def __init__(self, *keys: str, order: str = "ts"):
        self.keys, self.order = keys, order

    @property
    def all(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def upto(self):
        return self.all.rowsBetween(Window.unboundedPreceding, 0)

    def w(self, n: int):
        return self.all.rowsBetween(-(n - 1), 0)

    def prior(self, n: int):
        """The n rows before the current one."""
        return self.all.rowsBetween(-n, -1)

    def full(self, n: int, value: Column) -> Column:
        return F.when(F.count(F.lit(1)).over(self.w(n)) == n, value)

    def clean(self, n: int, x, value: Column) -> Column:
        return F.when(F.count(c(x)).over(self.w(n)) == n, value)

    def at_least(self, k: int, n: int, x, value: Column) -> Column:
        return F.when(F.count(c(x)).over(self.w(n)) >= k, value)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(c(x), n).over(self.all)

    def agg(self, f, x, n: int) -> Column:
        return f(c(x)).over(self.w(n))

    # -- returns
    def ret(self, n: int, x="close") -> Column:
        return c(x) / self.lag(x, n) - 1

    def logret(self, n: int, x="close") -> Column:
        return F.log(c(x) / self.lag(x, n))

    def ret_skip(self, near: int, far: int, x="close") -> Column:
        return self.lag(x, near) / self.lag(x, far) - 1

    # -- dispersion
    def vol(self, n: int, x="lr", per_year: float = 365.0, population: bool = False) -> Column:
        return self.clean(n, x, self.agg(F.stddev_pop if population else F.stddev_samp, x, n) * F.sqrt(F.lit(per_year)))

    def semivol(self, n: int, x="lr", per_year: float = 365.0, lost: int = 1) -> Column:
        down = F.pow(F.least(c(x), F.lit(0.0)), 2)
        return self.clean(n, x, F.sqrt(self.agg(F.sum, down, n) / (n - lost)) * F.sqrt(F.lit(per_year)))

    def semi(self, n: int, up: bool, x="r1") -> Column:
        part = F.when(c(x) > 0 if up else c(x) < 0, c(x) * c(x)).otherwise(0.0)
        return self.clean(n, x, F.sqrt(self.agg(F.sum, part, n)))

    def skew(self, n: int, x="lr") -> Column:
        """Population skewness; null where the variance is zero."""
        m, s = self.agg(F.avg, x, n), self.agg(F.stddev_pop, x, n)
        third = self.agg(F.avg, F.pow(c(x), 3), n) - 3 * m * self.agg(F.avg, F.pow(c(x), 2), n) + 2 * F.pow(m, 3)
        return self.clean(n, x, F.when(s > 0, third / F.pow(s, 3)))

    # -- extremes
    def dist_high(self, n: int, x="close") -> Column:
        return self.full(n, c(x) / self.agg(F.max, x, n) - 1)

    def dist_low(self, n: int, x="close") -> Column:
        return self.full(n, c(x) / self.agg(F.min, x, n) - 1)

    def max_drawdown(self, n: int, x="close") -> Column:
        """Worst close against the running peak within the window."""
        values = F.collect_list(c(x)).over(self.w(n))
        zero = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

        def step(a, v):
            peak = F.greatest(a["peak"], v)
            return F.struct(peak.alias("peak"), F.least(a["worst"], v / peak - 1).alias("worst"))

        return self.full(n, F.aggregate(values, zero, step, lambda a: a["worst"]))

    # -- volume and liquidity
    def median(self, n: int, x) -> Column:
        return F.percentile(c(x), 0.5).over(self.w(n))

    def amihud(self, n: int, x="r1", notional="quote_volume", scale: float = 1.0) -> Column:
        value = F.when(c(notional) > 0, F.abs(c(x)) / c(notional))
        return self.clean(n, value, self.agg(F.avg, value, n) * scale)

    def surprise(self, x, n: int = 20, least: int = 10) -> Column:
        """x over its median of up to n rows, of which ``least`` must be present."""
        m = self.median(n, x)
        return self.at_least(least, n, x, F.when(m > 0, c(x) / m))

    def surge(self, x, n: int = 20) -> Column:
        """x over the median of the n rows before it."""
        m = F.percentile(c(x), 0.5).over(self.prior(n))
        return F.when((F.count(c(x)).over(self.prior(n)) == n) & (m > 0), c(x) / m)

    def efficiency(self, n: int, x="r1") -> Column:
        return self.clean(n, x, F.abs(self.ret(n)) / (self.agg(F.sum, F.abs(c(x)), n) + 1e-12))

    def zscore(self, n: int, x, eps: float = 1e-12) -> Column:
        return self.clean(n, x, (c(x) - self.agg(F.avg, x, n)) / (self.agg(F.stddev_pop, x, n) + eps))

    def vwap_dist(self, n: int, typical, volume="volume") -> Column:
        v = self.agg(F.sum, volume, n)
        return self.full(n, F.when(v > 1e-12, F.log(c("close") / (self.agg(F.sum, typical * c(volume), n) / v))))

    # -- relations
    def beta(self, n: int, own, other, least: int | None = None) -> Column:
        both = c(own).isNotNull() & c(other).isNotNull()
        x, y = F.when(both, c(other)), F.when(both, c(own))
        pairs = F.count(x).over(self.w(n))
        var = F.var_pop(x).over(self.w(n))
        return F.when((pairs >= (least or n)) & (var > 1e-18), F.covar_pop(y, x).over(self.w(n)) / var)

    def autocorr(self, n: int, x) -> Column:
        return F.corr(c(x), c(f"{x}_lag")).over(self.w(n))

    # -- runs
    def run_length(self, flag: Column) -> Column:
        """Consecutive rows up to this one on which the flag holds; null where it doesn't."""
        since = F.last(F.when(~flag, F.col("idx")), ignorenulls=True).over(self.upto)
        return F.when(flag, F.col("idx") - F.coalesce(since, F.lit(0)))


def with_basics(bars: DataFrame, *keys: str, order: str = "ts") -> DataFrame:
    """Add idx (from 1), pc (prior close), r1 and lr (simple and log return) and tr (true range)."""
    t = Trailing(*keys, order=order)
    out = bars.withColumn("idx", F.row_number().over(t.all)).withColumn("pc", t.lag("close"))
    span = F.col("high") - F.col("low")
    return (
        out.withColumn("r1", F.col("close") / F.col("pc") - 1)
        .withColumn("lr", F.log(F.col("close") / F.col("pc")))
        .withColumn("tr", F.greatest(span, F.coalesce(F.abs(F.col("high") - F.col("pc")), span), F.coalesce(F.abs(F.col("low") - F.col("pc")), span)))
    )
