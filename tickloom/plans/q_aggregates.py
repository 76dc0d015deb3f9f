"""Queries for aggregations: tape, book, calendars, positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bars as B
from ..operators.quantiles import quantiles
from ..registry import register
from . import base
from .base import ntz, table

col = F.col


@register("resample_ohlcv", f"WITH {base.HB0} SELECT asset, ts, open, high, low, close, volume, round(quote_volume, 6) AS quote_volume, trades FROM hb0")
def resample_ohlcv(spark, sf_dir):
    return base.hourly(spark, sf_dir).withColumn("quote_volume", F.round("quote_volume", 6))


@register("resample_daily_from_hourly", f"WITH {base.HB0} SELECT asset, date_trunc('day', ts)::TIMESTAMP AS bucket, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM hb0 GROUP BY 1, 2")
def resample_daily(spark, sf_dir):
    return B.coarser(base.hourly(spark, sf_dir), ["asset"], ntz(F.date_trunc("day", "ts")))


@register("flow_minute", "SELECT event_type AS asset, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n_trades, round(sum(value), 6) AS notional, round(CASE WHEN sum(value) > 0 THEN sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END) / sum(value) ELSE 0 END, 6) AS taker_buy_ratio FROM events GROUP BY 1, 2")
def flow_minute(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(col("event_type").alias("asset"), ntz(F.date_trunc("minute", "ts")).alias("minute"))
    buys, total = F.sum(F.when(col("event_id") % 2 == 0, col("value")).otherwise(0.0)), F.sum("value")
    return e.agg(F.count("*").alias("n_trades"), F.round(total, 6).alias("notional"), F.round(F.when(total > 0, buys / total).otherwise(0.0), 6).alias("taker_buy_ratio"))


@register("effective_spread", "WITH p AS (SELECT l_suppkey AS id, l_extendedprice AS ask, l_extendedprice * (1 - l_discount) AS bid, l_linenumber AS anchor FROM lineitem), x AS (SELECT *, (ask - bid) / ((ask + bid) / 2) * 1e4 AS x FROM p) SELECT id, round(CASE WHEN count(x) >= 5 AND count(DISTINCT anchor) >= 3 THEN median(x) END, 6) AS spread_bps, count(x) AS n FROM x GROUP BY 1")
def effective_spread(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(col("l_suppkey").alias("id"), col("l_extendedprice").alias("ask"), (col("l_extendedprice") * (1 - col("l_discount"))).alias("bid"), col("l_linenumber").alias("anchor"))
    return A.effective_spread(p, ["id"], "ask", "bid", "anchor").withColumn("spread_bps", F.round("spread_bps", 6))


@register("daily_cost", "SELECT event_type AS asset, ts::DATE AS day, round(quantile_cont(value, 0.75), 6) AS p75, round(CASE WHEN median(value) >= 2 THEN greatest(2.3 * (2 / median(value)) * 50, 1.5 * (2 / median(value)) * 10) END, 6) AS impact FROM events GROUP BY 1, 2")
def daily_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(col("event_type").alias("asset"), col("ts").cast("date").alias("day"), "value")
    q, depth = quantiles(e, ["asset", "day"], "value", {"p75": 0.75, "depth": 0.5}), col("depth")
    return q.select("asset", "day", F.round("p75", 6).alias("p75"), F.round(F.greatest(A.impact_bps(2, depth, 2.3, 50), A.impact_bps(2, depth, 1.5, 10)), 6).alias("impact"))


_LEVELS = "SELECT l_orderkey AS book, list({'px': px, 'sz': sz} ORDER BY px, sz) AS levels, min(px) AS best FROM (SELECT l_orderkey, l_extendedprice / l_quantity AS px, l_quantity AS sz FROM lineitem) GROUP BY 1"
_WALK = "list_reduce(list_transform(levels, lambda v: {'px': v.px, 'left': v.px * v.sz, 'qty': 0.0::DOUBLE}), lambda a, v: {'px': v.px, 'left': a.left - least(a.left, v.left), 'qty': a.qty + least(a.left, v.left) / v.px}, {'px': 0.0::DOUBLE, 'left': 30000.0::DOUBLE, 'qty': 0.0::DOUBLE})"


def _books(spark, sf_dir):
    px = (col("l_extendedprice") / col("l_quantity")).alias("px")
    rows = table(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("book"), px, col("l_quantity").alias("sz"))
    return rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("px", "sz"))).alias("levels"), F.min("px").alias("best"))


@register("book_walk_cost", f"WITH b AS ({_LEVELS}), w AS (SELECT book, best, {_WALK} AS s FROM b) SELECT book, round(CASE WHEN s.left <= 1e-9 THEN abs(30000.0 / s.qty / best - 1) * 1e4 END, 4) AS cost_bps FROM w")
def book_walk_cost(spark, sf_dir):
    return _books(spark, sf_dir).select("book", F.round(A.walk_cost_bps(col("levels"), 30_000, col("best")), 4).alias("cost_bps"))


@register("book_levels", f"WITH b AS ({_LEVELS}) SELECT book, len(levels[1:3])::INT AS depth, round(levels[1].px, 6) AS best_px, round(list_sum(list_transform(levels[1:3], lambda v: v.px * v.sz)), 4) AS notional FROM b")
def book_levels(spark, sf_dir):
    top = F.slice("levels", 1, 3)
    return _books(spark, sf_dir).select("book", F.size(top).alias("depth"), F.round(F.get("levels", F.lit(0))["px"], 6).alias("best_px"), F.round(F.aggregate(top, F.lit(0.0), lambda a, v: a + v["px"] * v["sz"]), 4).alias("notional"))


@register("book_cost_summary", "SELECT l_shipdate::DATE AS day, count(*) AS samples, round(median(l_discount), 6) AS spread_med, round(quantile_cont(l_discount, 0.75), 6) AS spread_p75, round(median(l_extendedprice), 6) AS depth_med FROM lineitem GROUP BY 1")
def book_cost_summary(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(col("l_shipdate").cast("date").alias("day"))
    return g.agg(F.count("*").alias("samples"), F.round(F.percentile("l_discount", 0.5), 6).alias("spread_med"), F.round(F.percentile("l_discount", 0.75), 6).alias("spread_p75"), F.round(F.percentile("l_extendedprice", 0.5), 6).alias("depth_med"))


@register("percentile_linear", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY 1")
def percentile_linear(spark, sf_dir):
    q = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {f"p{p}": p / 100 for p in (10, 50, 90)})
    return q.select("o_orderpriority", *(F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")))


@register("liquidity_profile", f"WITH {base.HB0}, r AS (SELECT asset, quote_volume, row_number() OVER (PARTITION BY asset ORDER BY quote_volume) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM hb0 WHERE hour(ts) IN (13, 14, 15)) SELECT asset, round(max(CASE WHEN k = n // 2 AND n >= 30 THEN quote_volume END), 6) AS median, max(n) AS n FROM r GROUP BY 1")
def liquidity_profile(spark, sf_dir):
    x = base.hourly(spark, sf_dir).where(F.hour("ts").isin(13, 14, 15))
    return A.upper_median(x, ["asset"], "quote_volume", 30).select("asset", F.round("median", 6).alias("median"), "n")


@register("hour_profile", f"WITH {base.HB0}, a AS (SELECT asset, avg(quote_volume) AS m FROM hb0 GROUP BY 1), h AS (SELECT asset, hour(ts)::INT AS hour, median(quote_volume) AS v, median((high - low) / close) AS rg FROM hb0 GROUP BY 1, 2) SELECT hour, round(avg(v / m), 6) AS volume, round(avg(rg), 6) AS spread FROM h JOIN a USING (asset) GROUP BY 1")
def hour_profile(spark, sf_dir):
    b = base.hourly(spark, sf_dir)
    means = b.groupBy("asset").agg(F.avg("quote_volume").alias("m"))
    hours = b.groupBy("asset", F.hour("ts").alias("hour")).agg(F.percentile("quote_volume", 0.5).alias("v"), F.percentile((col("high") - col("low")) / col("close"), 0.5).alias("rg"))
    return hours.join(means, "asset").groupBy("hour").agg(F.round(F.avg(col("v") / col("m")), 6).alias("volume"), F.round(F.avg("rg"), 6).alias("spread"))


@register("universe_rank_inputs", f"WITH {base.DB0} SELECT asset, max(ts) AS last_bar, count(*) AS bars, round(median(quote_volume) FILTER (ts >= TIMESTAMP '2000-01-01'), 6) AS turnover FROM db0 GROUP BY 1")
def universe_rank_inputs(spark, sf_dir):
    d = base.daily(spark, sf_dir)
    return d.groupBy("asset").agg(F.max("ts").alias("last_bar"), F.count("*").alias("bars"), F.round(F.percentile(F.when(col("ts") >= F.lit("2000-01-01").cast("timestamp_ntz"), col("quote_volume")), 0.5), 6).alias("turnover"))


_SECTOR = f"{base.MX}, s AS (SELECT m.*, s_nationkey % 5 AS sector, price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM mx m JOIN supplier ON asset = s_suppkey)"


def sectors(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select(col("s_suppkey").alias("asset"), (col("s_nationkey") % 5).alias("sector"))
    m = base.monthly(spark, sf_dir).join(sup, "asset")
    return m.withColumn("r", col("price") / F.lag("price").over(Window.partitionBy("asset").orderBy("ts")) - 1)


@register("market_factor", f"WITH {_SECTOR} SELECT ts, round(avg(r), 6) AS market, count(r) AS n FROM s GROUP BY 1 HAVING count(r) >= 20")
def market_factor(spark, sf_dir):
    return sectors(spark, sf_dir).groupBy("ts").agg(F.round(F.avg("r"), 6).alias("market"), F.count("r").alias("n")).where("n >= 20")


@register("sector_factor", f"WITH {_SECTOR} SELECT ts, sector, round(avg(r), 6) AS factor FROM s GROUP BY 1, 2 HAVING count(r) >= 3")
def sector_factor(spark, sf_dir):
    return sectors(spark, sf_dir).groupBy("ts", "sector").agg(F.round(F.avg("r"), 6).alias("factor"), F.count("r").alias("n")).where("n >= 3").drop("n")


@register("breadth", f"WITH {_SECTOR} SELECT ts, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END), 6) AS positive, round(median(r), 6) AS mid, round(stddev_pop(r), 6) AS dispersion FROM s GROUP BY 1 HAVING count(r) >= 20")
def breadth(spark, sf_dir):
    g = sectors(spark, sf_dir).groupBy("ts").agg(F.round(F.avg((col("r") > 0).cast("double")), 6).alias("positive"), F.round(F.percentile("r", 0.5), 6).alias("mid"), F.round(F.stddev_pop("r"), 6).alias("dispersion"), F.count("r").alias("n"))
    return g.where("n >= 20").drop("n")


@register("sector_median", f"WITH {_SECTOR} SELECT asset, ts, round(CASE WHEN count(r) OVER g >= 3 THEN r - median(r) OVER g END, 6) + 0.0 AS relative FROM s WINDOW g AS (PARTITION BY ts, sector)")
def sector_median(spark, sf_dir):
    g = Window.partitionBy("ts", "sector")
    return sectors(spark, sf_dir).select("asset", "ts", (F.round(F.when(F.count("r").over(g) >= 3, col("r") - F.percentile("r", 0.5).over(g)), 6) + 0.0).alias("relative"))


@register("dominant_currency", "SELECT o_custkey, arg_min(o_orderpriority, {'a': -n, 'b': o_orderpriority}) AS unit FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def dominant_currency(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-col("n"), "o_orderpriority")).alias("unit"))


@register("unique_statement_value", "SELECT o_custkey, CASE WHEN count(DISTINCT o_totalprice) FILTER (o_orderstatus = 'F') = 1 THEN max(o_totalprice) FILTER (o_orderstatus = 'F') WHEN count(DISTINCT o_totalprice) FILTER (o_orderstatus = 'O') = 1 THEN max(o_totalprice) FILTER (o_orderstatus = 'O') END AS value FROM orders GROUP BY 1")
def unique_statement_value(spark, sf_dir):
    """By concepts in priority order: the value, if there is exactly one."""
    pick = lambda k: F.when(F.countDistinct(F.when(col("o_orderstatus") == k, col("o_totalprice"))) == 1, F.max(F.when(col("o_orderstatus") == k, col("o_totalprice"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(pick("F"), pick("O")).alias("value"))


@register("last_per_day", "SELECT event_type, ts::DATE AS day, arg_max(value, {'a': ts, 'b': event_id}) AS close, arg_max(value, {'a': ts, 'b': event_id}) FILTER (hour(ts) * 60 + minute(ts) <= 1050) AS close_1730 FROM events GROUP BY 1, 2")
def last_per_day(spark, sf_dir):
    k = F.struct("ts", "event_id")
    early = F.hour("ts") * 60 + F.minute("ts") <= 1050
    return table(spark, sf_dir, "events").groupBy("event_type", col("ts").cast("date").alias("day")).agg(F.max_by("value", k).alias("close"), F.max_by("value", F.when(early, k)).alias("close_1730"))


@register("stitch_aliases", f"""WITH {base.DB0}, x AS (SELECT asset, ts::DATE AS day, 1 + avg(close) / 1e7 AS v FROM db0 GROUP BY 1, 2),
  a AS (SELECT * FROM x WHERE asset = 'P1' AND day < DATE '1998-01-01'), b AS (SELECT * FROM x WHERE asset = 'P2' AND day > DATE '1997-06-01'),
  s AS (SELECT max(a.day) AS d, arg_max(a.v / b.v, a.day) AS k FROM a JOIN b USING (day))
  SELECT day, round(v, 4) AS v FROM a WHERE NOT (day > (SELECT d FROM s) AND day IN (SELECT day FROM b)) UNION ALL SELECT day, round(v * k, 4) FROM b, s WHERE day > d""")
def stitch_aliases(spark, sf_dir):
    x = base.daily(spark, sf_dir).groupBy("asset", col("ts").cast("date").alias("day")).agg((1 + F.avg("close") / 1e7).alias("v"))
    x = x.where("(asset = 'P1' and day < '1998-01-01') or (asset = 'P2' and day > '1997-06-01')")
    return A.stitch(x, ["P1", "P2"], "asset", "day", "v").select("day", F.round("v", 4).alias("v"))


@register("observation_log", "SELECT user_id, event_type, min(ts) AS first_observed FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, min(ts) FROM events WHERE event_id % 3 <> 0 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 3 = 0) GROUP BY 1, 2")
def observation_log(spark, sf_dir):
    """A log of first sights, and those of a new batch that it lacks."""
    e = table(spark, sf_dir, "events")
    first = lambda df: df.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_observed"))
    log, fresh = first(e.where("event_id % 3 = 0")), first(e.where("event_id % 3 <> 0"))
    return log.union(fresh.join(log, ["user_id", "event_type"], "left_anti"))


_SIGNED = "CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END"


@register("position_fold", f"""WITH f AS (SELECT l_suppkey AS asset, list({{'q': {_SIGNED}, 'p': l_extendedprice / l_quantity}} ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, {_SIGNED}, l_extendedprice / l_quantity) AS fs FROM lineitem GROUP BY 1),
  s AS (SELECT asset, list_reduce(fs, lambda a, f: {{'q': a.q + f.q, 'p': CASE WHEN abs(a.q + f.q) < 1e-12 THEN 0.0 WHEN a.q = 0 OR sign(a.q) = sign(f.q) THEN (a.q * a.p + f.q * f.p) / (a.q + f.q) WHEN sign(a.q + f.q) <> sign(a.q) THEN f.p ELSE a.p END}}, {{'q': 0.0::DOUBLE, 'p': 0.0::DOUBLE}}) AS s FROM f)
  SELECT asset, s.q AS qty, round(s.p, 4) AS avg_price FROM s""")
def position_fold(spark, sf_dir):
    q = F.when(col("l_returnflag") == "R", -col("l_quantity")).otherwise(col("l_quantity"))
    f = table(spark, sf_dir, "lineitem").select(col("l_suppkey").alias("asset"), "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", q.alias("qty_"), (col("l_extendedprice") / col("l_quantity")).alias("px"))
    out = A.position_fold(f, ["asset"], ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber"], "qty_", "px", span=F.date_trunc("month", "l_shipdate"))
    return out.withColumn("avg_price", F.round("avg_price", 4))


@register("book_fold", f"WITH p AS (SELECT l_suppkey AS id, sum({_SIGNED}) AS q, sum(l_tax) AS fees FROM lineitem GROUP BY 1), m AS (SELECT s_suppkey AS id, s_acctbal AS mark FROM supplier WHERE s_acctbal > 0) SELECT round(sum(fees), 4) AS fees, round(sum(CASE WHEN q > 0 THEN q * mark END), 2) AS long_notional, round(sum(CASE WHEN q < 0 THEN -q * mark END), 2) AS short_notional, round(sum(abs(q * mark)), 2) AS gross, round(sum(q * mark), 2) AS net, count(*) FILTER (mark IS NULL) AS unpriced FROM p LEFT JOIN m USING (id)")
def book_fold(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(col("l_suppkey").alias("id")).agg(F.sum(F.when(col("l_returnflag") == "R", -col("l_quantity")).otherwise(col("l_quantity"))).alias("q"), F.sum("l_tax").alias("fees"))
    m = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(col("s_suppkey").alias("id"), col("s_acctbal").alias("mark"))
    v = col("q") * col("mark")
    return p.join(m, "id", "left").agg(F.round(F.sum("fees"), 4).alias("fees"), F.round(F.sum(F.when(col("q") > 0, v)), 2).alias("long_notional"), F.round(F.sum(F.when(col("q") < 0, -v)), 2).alias("short_notional"), F.round(F.sum(F.abs(v)), 2).alias("gross"), F.round(F.sum(v), 2).alias("net"), F.count_if(col("mark").isNull()).alias("unpriced"))


@register("reserved_balances", "SELECT c_mktsegment AS currency, round(sum(c_acctbal), 2) AS total, round(coalesce(sum(r), 0), 2) AS reserved, round(sum(c_acctbal) - coalesce(sum(r), 0), 2) AS available FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS r FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def reserved_balances(spark, sf_dir):
    r = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("r"))
    held, total = F.coalesce(F.sum("r"), F.lit(0.0)), F.sum("c_acctbal")
    return table(spark, sf_dir, "customer").join(r, "c_custkey", "left").groupBy(col("c_mktsegment").alias("currency")).agg(F.round(total, 2).alias("total"), F.round(held, 2).alias("reserved"), F.round(total - held, 2).alias("available"))


@register("asset_report", f"WITH {base.HB} SELECT asset, count(r1) AS trades, round(sum(r1) * 1e4, 4) AS net_bps, round(avg(CASE WHEN r1 > 0 THEN 1.0 WHEN r1 <= 0 THEN 0.0 END), 6) AS hit_rate FROM hb GROUP BY 1")
def asset_report(spark, sf_dir):
    return base.hourly_basics(spark, sf_dir).groupBy("asset").agg(F.count("r1").alias("trades"), F.round(F.sum("r1") * 1e4, 4).alias("net_bps"), F.round(F.avg((col("r1") > 0).cast("double")), 6).alias("hit_rate"))


@register("daily_pnl", "WITH s AS (SELECT user_id, ts::DATE AS day, sum(value) / 5 AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), d AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM s GROUP BY 1) SELECT user_id, day, round(coalesce(v, 0), 6) AS total FROM d LEFT JOIN s USING (user_id, day)")
def daily_pnl(spark, sf_dir):
    """Each user's days from the first purchase to the last; most of them have none."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("day", col("ts").cast("date"))
    return A.zero_filled_days(e, "day", F.sum("value") / 5, ["user_id"]).withColumn("total", F.round("total", 6))


@register("calendar_days", "SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH))::DATE AS month FROM orders")
def calendar_days(spark, sf_dir):
    span = table(spark, sf_dir, "orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))


@register("trade_pnl", "SELECT o_orderkey, round(((o_totalprice - 200000) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * 0.5 - 4.5) * 2, 2) AS dollars FROM orders")
def trade_pnl(spark, sf_dir):
    sign = F.when(col("o_orderstatus") == "F", -1).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(((col("o_totalprice") - 200_000) * sign * 0.5 - 4.5) * 2, 2).alias("dollars"))


@register("kill_flag", "WITH p AS (SELECT user_id, ts, event_id, sum(value - 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pnl FROM events) SELECT user_id, min(ts) AS killed_at FROM p WHERE pnl <= -50 GROUP BY 1")
def kill_flag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").withColumn("pnl", F.sum(col("value") - 20).over(w)).where("pnl <= -50").groupBy("user_id").agg(F.min("ts").alias("killed_at"))


@register("sleeve_totals", "SELECT n_name, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS net FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def sleeve_totals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("net"))


@register("exec_schedule", "WITH o AS (SELECT o_orderkey, o_totalprice::DECIMAL(28,6) AS q, CASE WHEN o_totalprice < 100000 THEN 2 WHEN o_totalprice < 300000 THEN 4 ELSE 8 END AS parts FROM orders) SELECT o_orderkey, p::INT AS part, round(CASE WHEN p < parts THEN ((q * 100)::BIGINT // parts) / 100.0 ELSE q - ((q * 100)::BIGINT // parts) / 100.0 * (parts - 1) END::DOUBLE, 2) AS slice_qty FROM o, range(1, 9) t(p) WHERE p <= parts")
def exec_schedule(spark, sf_dir):
    parts = F.when(col("o_totalprice") < 100_000, 2).when(col("o_totalprice") < 300_000, 4).otherwise(8)
    return A.slices(table(spark, sf_dir, "orders"), "o_totalprice", parts).select("o_orderkey", "part", "slice_qty")


@register("period_partition", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def period_partition(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@register("first_listing", "SELECT o_custkey AS asset, min(o_orderdate::DATE) AS first FROM orders GROUP BY 1")
def first_listing(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("asset")).agg(F.min(col("o_orderdate").cast("date")).alias("first"))


@register("daily_funding", "SELECT event_type AS asset, ts::DATE AS day, round(sum(value), 6) AS rate, count(*) AS intervals FROM events WHERE hour(ts) % 8 = 0 GROUP BY 1, 2")
def daily_funding(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.hour("ts") % 8 == 0).groupBy(col("event_type").alias("asset"), col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("rate"), F.count("*").alias("intervals"))


@register("funding_sum_n", "WITH f AS (SELECT user_id, ts::DATE AS day, sum(value) AS r FROM events WHERE event_type = 'signup' GROUP BY 1, 2), d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events) SELECT d.user_id, d.day, round(coalesce(sum(f.r) FILTER (f.day > d.day - 7), 0), 6) AS funding_7d, round(coalesce(sum(f.r), 0), 6) AS funding_30d FROM d LEFT JOIN f ON d.user_id = f.user_id AND f.day > d.day - 30 AND f.day <= d.day GROUP BY 1, 2")
def funding_sum_n(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", col("ts").cast("date"))
    r = e.groupBy("user_id", "day").agg(F.coalesce(F.sum(F.when(col("event_type") == "signup", col("value"))), F.lit(0.0)).alias("r")).withColumn("k", F.unix_date("day"))
    w = Window.partitionBy("user_id").orderBy("k")
    return r.select("user_id", "day", F.round(F.sum("r").over(w.rangeBetween(-6, 0)), 6).alias("funding_7d"), F.round(F.sum("r").over(w.rangeBetween(-29, 0)), 6).alias("funding_30d"))


@register("funding_chg_z", "WITH f AS (SELECT event_type AS asset, ts::DATE AS day, sum(value) / 1e4 AS r FROM events GROUP BY 1, 2), s AS (SELECT asset, day, sum(r) OVER (PARTITION BY asset ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS f7, sum(r) OVER (PARTITION BY asset ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS f30 FROM f) SELECT asset, day, round(f7 - lag(f7, 7) OVER (PARTITION BY asset ORDER BY day), 6) + 0.0 AS funding_chg, round((f7 - f30 / 30 * 7) / (abs(f30) / 30 * 7 + 1e-6), 6) + 0.0 AS funding_z FROM s")
def funding_chg_z(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(col("event_type").alias("asset"), col("ts").cast("date").alias("day")).agg((F.sum("value") / 1e4).alias("r")).withColumn("k", F.unix_date("day"))
    w = Window.partitionBy("asset").orderBy("k")
    s = r.withColumn("f7", F.sum("r").over(w.rangeBetween(-6, 0))).withColumn("f30", F.sum("r").over(w.rangeBetween(-29, 0)))
    z = (col("f7") - col("f30") / 30 * 7) / (F.abs("f30") / 30 * 7 + 1e-6)
    return s.select("asset", "day", (F.round(col("f7") - F.lag("f7", 7).over(w), 6) + 0.0).alias("funding_chg"), (F.round(z, 6) + 0.0).alias("funding_z"))
