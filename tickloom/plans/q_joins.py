"""Queries for point-in-time joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..registry import register
from . import base
from .base import ntz, table

col = F.col
_EV = "SELECT event_id, user_id, ts, epoch_us(ts) AS t, event_type, value FROM events"


def _side(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(col("event_type") == kind).select("event_id", "user_id", "ts", "value")


def _asof(name, tolerance, strict, shift_left=0, shift_right=0):
    cmp = "<" if strict else "<="
    tol = f"CASE WHEN l.t + {shift_left} - r.t - {shift_right} <= {tolerance * 1_000_000} THEN {{}} END" if tolerance else "{}"

    @register(
        name,
        f"""WITH l AS ({_EV} WHERE event_type = 'view'), r AS ({_EV} WHERE event_type = 'click'),
        m AS (SELECT l.event_id, max({{'t': r.t, 'v': r.value}}) AS b FROM l JOIN r ON l.user_id = r.user_id AND r.t + {shift_right} {cmp} l.t + {shift_left} GROUP BY 1)
        SELECT l.event_id, l.user_id, l.ts, {tol.format('m.b.v').replace('r.t', 'm.b.t')} AS last_value FROM l LEFT JOIN m USING (event_id)""",
    )
    def query(spark, sf_dir):
        left, right = _side(spark, sf_dir, "view").drop("value"), _side(spark, sf_dir, "click")
        out = J.asof_join(left, right, ["user_id"], J.micros("ts") + shift_left, J.micros("ts") + shift_right, "hit", ["value"], tolerance_s=tolerance, strict=strict)
        return out.select("event_id", "user_id", "ts", col("hit.value").alias("last_value"))


_asof("asof_backward", 43_200, False)
_asof("asof_strict", None, True)
_asof("asof_le_level", None, False)
_asof("asof_shifted", 600_000, False, 60_000_000, 300_000_000)


@register("latest_per_key", "SELECT user_id, arg_max(value, {'a': ts, 'b': event_id}) AS value, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return J.latest_per_key(table(spark, sf_dir, "events").where(col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")), ["user_id"], ["ts", "event_id"], ["value", "event_type"])


@register("exact_time_join", f"WITH {base.HB} SELECT a.asset, a.ts, round(a.r1, 6) AS own, round(b.r1, 6) AS bench, round(a.r1 - b.r1, 6) + 0.0 AS relative FROM hb a LEFT JOIN hb b ON a.ts = b.ts AND b.asset = 'CLICK'")
def exact_time_join(spark, sf_dir):
    bars = base.hourly_basics(spark, sf_dir)
    bench = bars.where("asset = 'CLICK'").select("ts", col("r1").alias("bench"))
    return bars.join(bench, "ts", "left").select("asset", "ts", F.round("r1", 6).alias("own"), F.round("bench", 6).alias("bench"), (F.round(col("r1") - col("bench"), 6) + 0.0).alias("relative"))


@register("forward_exact_join", f"WITH {base.HB} SELECT a.asset, a.ts, a.close, b.close AS close_6h FROM hb a LEFT JOIN hb b ON a.asset = b.asset AND b.ts = a.ts + INTERVAL 6 HOUR")
def forward_exact_join(spark, sf_dir):
    return J.forward_exact(base.hourly(spark, sf_dir), ["asset"], "ts", 6 * 3600, "close", "close_6h").select("asset", "ts", "close", "close_6h")


@register("forward_asof_exit", f"WITH {base.HB}, m AS (SELECT a.asset, a.ts, arg_max(b.close, b.ts) AS exit_price FROM hb a JOIN hb b ON a.asset = b.asset AND b.ts <= a.ts + INTERVAL 24 HOUR GROUP BY 1, 2) SELECT a.asset, a.ts, a.close AS entry, exit_price, round(exit_price / a.close - 1, 6) + 0.0 AS ret FROM hb a JOIN m USING (asset, ts)")
def forward_asof_exit(spark, sf_dir):
    bars = base.hourly(spark, sf_dir).select("asset", "ts", "close")
    out = J.asof_join(bars, bars, ["asset"], J.micros("ts") + 86_400_000_000, J.micros("ts"), "exit", ["close"])
    return out.select("asset", "ts", col("close").alias("entry"), col("exit.close").alias("exit_price"), (F.round(col("exit.close") / col("close") - 1, 6) + 0.0).alias("ret"))


@register("slow_fast_merge", f"WITH {base.HB}, d AS (SELECT asset, ts::DATE AS day, max(close) AS hi, count(*) AS n FROM hb GROUP BY 1, 2) SELECT h.asset, h.ts, h.close, d.hi, d.n FROM hb h JOIN d ON h.asset = d.asset AND h.ts::DATE = d.day")
def slow_fast_merge(spark, sf_dir):
    fast = base.hourly(spark, sf_dir).withColumn("day", col("ts").cast("date"))
    slow = fast.groupBy("asset", "day").agg(F.max("close").alias("hi"), F.count("*").alias("n"))
    return fast.join(slow, ["asset", "day"]).select("asset", "ts", "close", "hi", "n")


_DAYS = "date_diff('day', DATE '1970-01-01', ts::DATE)"


@register("range_join_window", f"WITH d AS (SELECT DISTINCT user_id, {_DAYS} AS day FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, {_DAYS} AS day, value FROM events WHERE event_type = 'error') SELECT d.user_id, d.day::INT AS day, count(e.day) AS n, round(coalesce(sum(e.value), 0), 6) AS total FROM d LEFT JOIN e ON d.user_id = e.user_id AND e.day > d.day - 10 AND e.day < d.day GROUP BY 1, 2")
def range_join_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.unix_date(col("ts").cast("date")))
    out = J.window_counts(e.where("event_type = 'purchase'").select("user_id", "day").distinct(), e.where("event_type = 'error'"), ["user_id"], "day", "day", 10, "value")
    return out.select("user_id", "day", "n", F.round("total", 6).alias("total"))


@register("path_join", f"WITH {base.HB} SELECT s.asset, s.ts, count(*) AS bars, max(b.high) AS best, min(b.low) AS worst FROM hb s JOIN hb b ON s.asset = b.asset AND b.ts > s.ts AND b.ts <= s.ts + INTERVAL 12 HOUR WHERE s.r1 > 1 GROUP BY 1, 2")
def path_join(spark, sf_dir):
    bars = base.hourly_basics(spark, sf_dir)
    # A path is at most twelve bars: each signal asks for its instants, an equi-join.
    signal = bars.where("r1 > 1").select("asset", "ts", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")).withColumn("at", J.micros("ts") + col("k").cast("long") * 3_600_000_000)
    path = bars.select("asset", J.micros("ts").alias("at"), "high", "low")
    return signal.join(path, ["asset", "at"]).groupBy("asset", "ts").agg(F.count("*").alias("bars"), F.max("high").alias("best"), F.min("low").alias("worst"))


@register("nearest_join", f"""WITH a AS ({_EV} WHERE event_type = 'view'), b AS ({_EV} WHERE event_type = 'click'),
  p AS (SELECT a.event_id, a.t - b.t AS gap, b.value FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 7200000000)
  SELECT event_id, arg_min(value, {{'a': abs(gap), 'b': gap, 'c': -value}}) AS value, min(abs(gap)) AS gap_us FROM p GROUP BY 1""")
def nearest_join(spark, sf_dir):
    """Nearest click to each view within two hours; on a tie the later one."""
    a, b = _side(spark, sf_dir, "view").drop("value"), _side(spark, sf_dir, "click")
    t, limit = J.micros("ts"), 7200
    back = J.asof_join(a, b, ["user_id"], t, t, "back", ["value"], tolerance_s=limit)
    both = J.asof_join(back, b, ["user_id"], -t, -t, "ahead", ["value"], tolerance_s=limit)
    down, up = t - col("back.t"), -t.cast("long") - col("ahead.t")
    pick = F.when(col("back").isNull() | (up <= down), F.struct(col("ahead.value").alias("value"), up.alias("gap_us"))).otherwise(F.struct(col("back.value").alias("value"), down.alias("gap_us")))
    pick = F.when(col("ahead").isNull(), F.struct(col("back.value").alias("value"), down.alias("gap_us"))).otherwise(pick)
    return both.where("back is not null or ahead is not null").select("event_id", pick.alias("p")).select("event_id", "p.value", "p.gap_us")


_NET = "sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)"


@register("full_outer_diff", f"WITH a AS (SELECT l_suppkey AS id, {_NET} AS q FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 7 <> 0 GROUP BY 1), b AS (SELECT l_suppkey AS id, {_NET} AS q FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 5 <> 0 GROUP BY 1) SELECT id, coalesce(a.q, 0) AS target, coalesce(b.q, 0) AS current, coalesce(a.q, 0) - coalesce(b.q, 0) AS change FROM a FULL JOIN b USING (id)")
def full_outer_diff(spark, sf_dir):
    net = F.sum(F.when(col("l_returnflag") == "R", -col("l_quantity")).otherwise(col("l_quantity")))
    side = lambda status, mod: table(spark, sf_dir, "lineitem").where((col("l_linestatus") == status) & (col("l_suppkey") % mod != 0)).groupBy(col("l_suppkey").alias("id")).agg(net.alias("q"))
    return J.full_outer_diff(side("O", 7), side("F", 5), ["id"], "q")


@register("reconcile", f"WITH ours AS (SELECT l_partkey AS id, sum(l_quantity) AS q FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY 1), venue AS (SELECT l_partkey AS id, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1) SELECT id, coalesce(ours.q, 0) AS target, coalesce(venue.q, 0) AS current, coalesce(ours.q, 0) - coalesce(venue.q, 0) AS change FROM ours FULL JOIN venue USING (id) WHERE abs(coalesce(ours.q, 0) - coalesce(venue.q, 0)) > 1e-9")
def reconcile(spark, sf_dir):
    """Positions from authorised fills against the venue's: what disagrees."""
    fills, known = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(col("o_orderkey").alias("l_orderkey"))
    ours = fills.join(known, "l_orderkey", "left_semi").groupBy(col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    venue = fills.where("l_linenumber <> 7").groupBy(col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    return J.full_outer_diff(ours, venue, ["id"], "q").where("abs(change) > 1e-9")


@register("session_offset", "WITH c AS (SELECT day, row_number() OVER (ORDER BY day) AS s FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)) SELECT a.day, a.s::INT AS session, b.day AS after_5 FROM c a LEFT JOIN c b ON b.s = a.s + 5")
def session_offset(spark, sf_dir):
    days = J.session_index(table(spark, sf_dir, "orders").select(col("o_orderdate").cast("date").alias("day")), "day")
    return days.join(days.select(col("day").alias("after_5"), (col("session") - 5).alias("session")), "session", "left").select("day", "session", "after_5")


@register("set_prefer", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def set_prefer(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(col("s_suppkey").alias("id"), col("s_name").alias("name"))
    return J.prefer(a, table(spark, sf_dir, "customer").select(col("c_custkey").alias("id"), col("c_name").alias("name")), ["id"])


@register("id_map_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON regexp_replace(lower(p_brand), '[^0-9]', '', 'g')::BIGINT = s_suppkey")
def id_map_join(spark, sf_dir):
    key = F.regexp_replace(F.lower("p_brand"), "[^0-9]", "").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("s_suppkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("p_partkey", "s_suppkey")


_RANKED = "SELECT asset, ts, row_number() OVER (PARTITION BY ts ORDER BY qty DESC, asset) AS rk FROM mx"


@register("hysteresis_join", f"WITH {base.MX}, r AS ({_RANKED}) SELECT a.asset, a.ts, a.rk::INT AS rk, coalesce(b.rk <= 10, false) AS incumbent, (a.rk <= 10 OR coalesce(b.rk <= 10 AND a.rk <= 15, false)) AS kept FROM r a LEFT JOIN r b ON a.asset = b.asset AND b.ts = a.ts - INTERVAL 1 MONTH")
def hysteresis_join(spark, sf_dir):
    r = base.monthly(spark, sf_dir).select("asset", "ts", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("qty"), "asset")).alias("rk"))
    held = r.where("rk <= 10").select("asset", ntz(F.expr("ts + INTERVAL 1 MONTH")).alias("ts"), F.lit(True).alias("held"))
    return r.join(held, ["asset", "ts"], "left").select("asset", "ts", "rk", F.coalesce("held", F.lit(False)).alias("incumbent"), ((col("rk") <= 10) | (F.coalesce("held", F.lit(False)) & (col("rk") <= 15))).alias("kept"))


@register("union_dedupe", "SELECT id, max(amount) AS amount FROM (SELECT o_custkey AS id, max(o_totalprice) AS amount FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer) GROUP BY 1")
def union_dedupe(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(col("o_custkey").alias("id"), col("o_totalprice").alias("amount"))
    return a.union(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).groupBy("id").agg(F.max("amount").alias("amount"))


@register("except_missing", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_missing(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select(col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(col("c_custkey").alias("id")).join(have, "id", "left_anti")


@register("intersect_common", "SELECT o_orderdate::DATE AS day FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5")
def intersect_common(spark, sf_dir):
    """Days on which every series has a row."""
    days = table(spark, sf_dir, "orders").select(col("o_orderdate").cast("date").alias("day"), "o_orderpriority").distinct()
    return days.groupBy("day").agg(F.count("*").alias("n")).where("n = 5").select("day")


@register("missing_partitions", "SELECT a.p AS o_orderpriority, a.d AS day FROM (SELECT * FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)) a ANTI JOIN (SELECT o_orderpriority AS p, o_orderdate::DATE AS d FROM orders) b ON a.p = b.p AND a.d = b.d")
def missing_partitions(spark, sf_dir):
    """(asset, day) of the calendar that the store lacks: the calendar stands in each asset's row."""
    have = table(spark, sf_dir, "orders").select("o_orderpriority", col("o_orderdate").cast("date").alias("day")).distinct()
    calendar = have.agg(F.collect_set("day").alias("days"))  # one row: the days of the store
    every = have.select("o_orderpriority").distinct().join(F.broadcast(calendar)).select("o_orderpriority", F.explode("days").alias("day"))
    return every.join(have, ["o_orderpriority", "day"], "left_anti")


@register("point_in_time_members", f"WITH {base.MX} SELECT m.asset, m.ts, m.qty FROM mx m JOIN ({_RANKED}) r ON m.asset = r.asset AND m.ts = r.ts WHERE r.rk <= 20")
def point_in_time_members(spark, sf_dir):
    m = base.monthly(spark, sf_dir)
    members = m.select("asset", "ts", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("qty"), "asset")).alias("rk")).where("rk <= 20").select("asset", "ts")
    return m.select("asset", "ts", "qty").join(members, ["asset", "ts"])


@register("listed_on_or_before", "WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o.o_orderkey FROM orders o JOIN f USING (o_custkey) WHERE first <= o_orderdate")
def listed_on_or_before(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return o.join(first, "o_custkey").where("first <= o_orderdate").select("o_orderkey")


@register("admission_filter", "WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), k AS (SELECT o.o_orderkey, o.o_orderdate FROM orders o JOIN f USING (o_custkey) WHERE o_orderdate >= first) SELECT o_orderkey, round(1.0 / count(*) OVER (PARTITION BY o_orderdate), 6) AS weight FROM k")
def admission_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    kept = o.join(first, "o_custkey").where("o_orderdate >= first")
    return kept.select("o_orderkey", F.round(1 / F.count("*").over(Window.partitionBy("o_orderdate")), 6).alias("weight"))
