"""Point-in-time joins.

As-of joins unite both sides and carry the last right row forward by key and time.  For keys of many
rows the carry comes in two levels, within spans of time that hold equally many rows and then over
the spans, so that a hot key is not sorted in one task.  Exact forward joins look for a row at a
given instant, never for the n-th next row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

DAY_S = 86_400
#: Keys of more rows than this are cut into SPANS spans (a square number); hot keys up to HOT_KEYS (about 16 MB of bounds) are broadcast.
SPAN_ROWS, SPANS, HOT_KEYS = 1_000_000, 1_024, 2_000


def micros(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def time_spans(times: DataFrame, keys: list[str], span_rows: int, spans: int = SPANS) -> DataFrame | None:
    """Bounds that cut each key of more than ``span_rows`` rows into ``spans`` spans of equally many rows; None if there is no such key.

    ``times`` has keys and j_t.  The bounds come from a sketch, written once: all that uses them sees
    the same.  ``coarse`` has every root of ``spans``-th bound, ``fine`` those between.
    """
    usual = times.where(F.col("j_t").isNotNull())
    many = staged(usual.groupBy(*keys).agg(F.count("*").alias("j_n")).where(F.col("j_n") > span_rows), "asof-hot")
    n, step = many.count(), math.isqrt(spans)
    if not n:
        return None
    some = usual.join(F.broadcast(many) if n <= HOT_KEYS else many, keys)
    bounds = some.groupBy(*keys).agg(F.percentile_approx("j_t", [i / spans for i in range(1, spans)], 10 * spans).alias("j_b"))
    fine = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: F.slice("j_b", i * step + 1, step - 1))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(step - 1)), lambda i: F.get("j_b", i * step - 1))
    return staged(bounds.select(*keys, coarse.alias("coarse"), fine.alias("fine")), "asof-bounds")


def _in_spans(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Add j_span: how many of the key's bounds are at or before j_t; 0 for keys without bounds."""
    few = bounds.count() <= HOT_KEYS
    held = rows.join(F.broadcast(bounds) if few else bounds, keys, "left")
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col("j_t")))
    return held.withColumn("j_at", upto("coarse")).withColumn("j_span", F.when(F.col("coarse").isNull() | F.col("j_t").isNull(), 0).otherwise(F.col("j_at") * (F.size("coarse") + 1) + upto(F.get("fine", F.col("j_at"))))).drop("coarse", "fine", "j_at")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: Column, right_on: Column, name: str, values: list[str], *, tolerance_s: float | None = None, strict: bool = False, span_s: int | None = None, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Add ``name``: a struct of the last right row (``values`` and its time ``t``, microseconds) not after the left row.

    ``left_on`` and ``right_on`` are times in microseconds; ``strict`` takes earlier rows only; rows
    older than ``tolerance_s`` give null.  Among right rows of one time the largest values count.
    Left rows keep all their columns and their number; a null time or key matches nothing.
    Rows are counted by key first; a task sorts the rows of a key of at most ``span_rows`` rows, or
    one span of a larger key and then one row for each of its spans.  ``span_s`` sets spans of so
    many seconds instead.
    """
    row = F.struct(right_on.alias("t"), *values)
    known = right_on.isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    r = right.where(known).groupBy(*keys, right_on.alias("j_t")).agg(F.max(row).alias("j_r"))
    kind = r.schema["j_r"].dataType
    a = left.select(*keys, left_on.alias("j_t"), F.lit(0 if strict else 1).alias("j_side"), F.lit(None).cast(kind).alias("j_r"), F.struct(*left.columns).alias("j_l"))
    b = r.select(*keys, "j_t", F.lit(1 if strict else 0).alias("j_side"), "j_r", F.lit(None).cast(a.schema["j_l"].dataType).alias("j_l"))
    if span_s is not None:
        cut = lambda rows: rows.withColumn("j_span", F.floor(F.col("j_t") / (span_s * 1_000_000)))
    else:
        bounds = time_spans(left.select(*keys, left_on.alias("j_t")).union(right.select(*keys, right_on.alias("j_t"))), keys, span_rows)
        cut = None if bounds is None else lambda rows: _in_spans(rows, bounds, keys)
    if cut is None:
        near = Window.partitionBy(*keys).orderBy("j_t", "j_side").rowsBetween(Window.unboundedPreceding, 0)
        found = a.union(b).withColumn("j_hit", F.last("j_r", ignorenulls=True).over(near)).where("j_l is not null")
    else:
        both = cut(a.union(b))
        near = Window.partitionBy(*keys, "j_span").orderBy("j_t", "j_side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("j_own", F.last("j_r", ignorenulls=True).over(near))
        tails = cut(b).groupBy(*keys, "j_span").agg(F.max("j_r").alias("j_tail"))
        spans = both.select(*keys, "j_span").distinct().join(tails, [*keys, "j_span"], "left")
        carried = spans.select(*keys, "j_span", F.last("j_tail", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("j_span").rowsBetween(Window.unboundedPreceding, -1)).alias("j_carry"))
        found = both.where("j_l is not null").join(carried, [*keys, "j_span"], "left").withColumn("j_hit", F.coalesce("j_own", "j_carry"))
    ok = F.col("j_t").isNotNull()
    if tolerance_s is not None:
        ok = ok & (F.col("j_t") - F.col("j_hit.t") <= int(tolerance_s * 1_000_000))
    return found.select("j_l.*", F.when(ok, F.col("j_hit")).alias(name))


def forward_exact(df: DataFrame, keys: list[str], ts: str, seconds: int, value: str, name: str) -> DataFrame:
    """Add the value of the row exactly ``seconds`` later (null if there is none)."""
    later = df.select(*keys, (micros(ts) - seconds * 1_000_000).alias("f_t"), F.col(value).alias(name))
    return df.withColumn("f_t", micros(ts)).join(later, [*keys, "f_t"], "left").drop("f_t")


def window_counts(decisions: DataFrame, events: DataFrame, keys: list[str], day: str, event_day: str, days: int, value: str | None = None) -> DataFrame:
    """Add n and total of the events in (day - days, day), both ends excluded, by key.

    Days of both sides are numbers; events are first summed by key and day, so the ordered range
    holds one row for a key and day.
    """
    amount = F.sum(value) if value else F.count("*").cast("double")
    e = events.groupBy(*keys, F.col(event_day).alias("w_day")).agg(F.count("*").alias("w_n"), amount.alias("w_v"))
    d = decisions.select(*keys, F.col(day).alias("w_day")).distinct().withColumn("w_ask", F.lit(1))
    both = d.join(e, [*keys, "w_day"], "full_outer")
    w = Window.partitionBy(*keys).orderBy("w_day").rangeBetween(-(days - 1), -1)
    got = both.withColumn("n", F.coalesce(F.sum("w_n").over(w), F.lit(0))).withColumn("total", F.coalesce(F.sum("w_v").over(w), F.lit(0.0))).where("w_ask = 1")
    return decisions.join(got.select(*keys, F.col("w_day").alias(day), "n", "total"), [*keys, day], "left")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row; one aggregation, no sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return best.select(*keys, "v.*")


def full_outer_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of both sides by key (absent: 0) and their difference."""
    x, y = a.select(*keys, F.col(value).alias("target")), b.select(*keys, F.col(value).alias("current"))
    out = x.join(y, keys, "full_outer").select(*keys, F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("current", F.lit(0.0)).alias("current"))
    return out.withColumn("change", F.col("target") - F.col("current"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first side, and those of the second whose key it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def session_index(sessions: DataFrame, day: str) -> DataFrame:
    """Distinct days numbered from 1 (a calendar: one row for each day)."""
    return sessions.select(day).distinct().withColumn("session", F.row_number().over(Window.orderBy(day)))
