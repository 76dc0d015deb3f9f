"""Queries for cross-sections, selections, eligibility, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators.joins import forward_exact
from ..operators.quantiles import quantiles
from ..registry import register
from . import base
from .base import ntz, table
from .q_aggregates import _SECTOR, sectors

col, B = F.col, ["ts"]


def _avg_rank(x, by="ts", view="m"):
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def _norm(x, by="ts"):
    return f"coalesce(2 * ({_avg_rank(x, by)} - 1) / greatest(count(*) OVER (PARTITION BY {by}) - 1, 1) - 1, 0)"


def _m(spark, sf_dir):
    return base.monthly(spark, sf_dir)


@register("entry_ranked_features", f"WITH {base.HB}, f AS (SELECT asset, ts, close / lag(close, 24) OVER w - 1 AS ret_24, CASE WHEN count(quote_volume) OVER w6 = 6 THEN median(quote_volume) OVER w6 END AS adv_6, CASE WHEN count(r1) OVER w24 = 24 THEN stddev_samp(r1) OVER w24 END AS vol_24 FROM hb {base.WINDOWS}) SELECT asset, ts, round({_norm('ret_24')}, 6) + 0.0 AS ret_24, round({_norm('adv_6')}, 6) + 0.0 AS adv_6, round({_norm('vol_24')}, 6) + 0.0 AS vol_24 FROM f")
def entry_ranked_features(spark, sf_dir):
    """Hourly bars, trailing features, ranked within the hour."""
    from ..operators.windows import Trailing

    t = Trailing("asset")
    f = base.hourly_basics(spark, sf_dir).select("asset", "ts", t.ret(24).alias("ret_24"), t.clean(6, "quote_volume", t.median(6, "quote_volume")).alias("adv_6"), t.vol(24, "r1", 1.0).alias("vol_24"))
    return f.select("asset", "ts", *base.rounded({k: X.rank_normalise(k, B) for k in ("ret_24", "adv_6", "vol_24")}))


@register("rank_normalise", f"WITH {base.MX} SELECT asset, ts, round({_norm('price')}, 6) + 0.0 AS price, round({_norm('qty')}, 6) + 0.0 AS qty FROM mx")
def rank_normalise(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", *base.rounded({k: X.rank_normalise(k, B) for k in ("price", "qty")}))


@register("rank_normalise_bucket", f"WITH {_SECTOR} SELECT asset, ts, sector, round({_norm('r', 'ts, sector')}, 6) + 0.0 AS r, (r IS NULL)::INT AS r_missing FROM s")
def rank_normalise_bucket(spark, sf_dir):
    return sectors(spark, sf_dir).select("asset", "ts", "sector", (F.round(X.rank_normalise("r", ["ts", "sector"]), 6) + 0.0).alias("r"), col("r").isNull().cast("int").alias("r_missing"))


@register("percentile_score", f"WITH {_SECTOR} SELECT asset, ts, round((2 * CASE WHEN count(r) OVER (PARTITION BY ts) < 5 OR r IS NULL THEN 50.0 ELSE 100 * ({_avg_rank('r')} - 0.5) / count(r) OVER (PARTITION BY ts) END + CASE WHEN count(disc) OVER (PARTITION BY ts) < 5 THEN 50.0 ELSE 100 - 100 * ({_avg_rank('disc')} - 0.5) / count(disc) OVER (PARTITION BY ts) END) / 3, 6) AS composite FROM s")
def percentile_score(spark, sf_dir):
    return sectors(spark, sf_dir).select("asset", "ts", F.round((2 * X.percentile_score("r", B) + X.percentile_score("disc", B, inverted=True)) / 3, 6).alias("composite"))


@register("universe_rank", f"WITH {base.MX}, r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY (n >= 3) DESC, qty DESC, asset) AS rank FROM mx) SELECT asset, ts, rank::INT AS rank, (n >= 3 AND rank <= 30) AS eligible, CASE WHEN n < 3 THEN 'history' WHEN rank > 30 THEN 'rank' END AS reason FROM r")
def universe_rank(spark, sf_dir):
    r = _m(spark, sf_dir).withColumn("rank", X.place(B, F.desc(col("n") >= 3), F.desc("qty"), col("asset")))
    return r.select("asset", "ts", "rank", ((col("n") >= 3) & (col("rank") <= 30)).alias("eligible"), F.when(col("n") < 3, "history").when(col("rank") > 30, "rank").alias("reason"))


@register("candidate_top", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 AND p_brand <> 'Brand#1' ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def candidate_top(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_retailprice > 0 and p_brand <> 'Brand#1'").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


@register("topk_signals", f"WITH {_SECTOR}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY qty DESC, asset) AS liq, row_number() OVER (PARTITION BY ts ORDER BY r DESC NULLS LAST, asset) AS mom FROM s) SELECT asset, ts, CASE WHEN liq <= 5 THEN 'liquidity' ELSE 'momentum' END AS rule FROM k WHERE liq <= 5 OR (mom <= 5 AND r IS NOT NULL)")
def topk_signals(spark, sf_dir):
    k = sectors(spark, sf_dir).withColumn("liq", X.place(B, F.desc("qty"), col("asset"))).withColumn("mom", X.place(B, F.desc_nulls_last("r"), col("asset")))
    return k.where("liq <= 5 or (mom <= 5 and r is not null)").select("asset", "ts", F.when(col("liq") <= 5, "liquidity").otherwise("momentum").alias("rule"))


_HYST = f"WITH {base.MX}, r AS (SELECT asset, ts, row_number() OVER (PARTITION BY ts ORDER BY qty DESC, asset) AS rk FROM mx), h AS (SELECT a.*, coalesce(b.rk <= 10, false) AS held FROM r a LEFT JOIN r b ON a.asset = b.asset AND b.ts = a.ts - INTERVAL 1 MONTH), s AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN held AND rk <= 15 THEN 0 ELSE 1 END, rk) AS seat FROM h) SELECT asset, ts, seat::INT AS seat FROM s WHERE seat <= 10"


@register("hysteresis_topk", _HYST)
def hysteresis_topk(spark, sf_dir):
    r = _m(spark, sf_dir).select("asset", "ts", X.place(B, F.desc("qty"), col("asset")).alias("rk"))
    held = r.where("rk <= 10").select("asset", ntz(F.expr("ts + INTERVAL 1 MONTH")).alias("ts"), F.lit(True).alias("held"))
    h = r.join(held, ["asset", "ts"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return X.hysteresis_topk(h, B, "rk", "held", 15, 10).select("asset", "ts", "seat")


@register("rank_ids", f"WITH {base.MX} SELECT asset, ts, row_number() OVER (PARTITION BY ts ORDER BY price / (1 + disc) DESC, asset)::INT AS place FROM mx")
def rank_ids(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", X.place(B, F.desc(col("price") / (1 + col("disc"))), col("asset")).alias("place"))


@register("top_bottom", f"WITH {_SECTOR}, k AS (SELECT asset, ts, row_number() OVER (PARTITION BY ts ORDER BY r DESC, asset) AS hi, row_number() OVER (PARTITION BY ts ORDER BY r, asset) AS lo FROM s WHERE r IS NOT NULL) SELECT asset, ts, CASE WHEN hi <= 5 THEN 0.2 ELSE -0.2 END AS weight FROM k WHERE hi <= 5 OR lo <= 5")
def top_bottom(spark, sf_dir):
    return X.top_bottom(sectors(spark, sf_dir), B, "r", 5).select("asset", "ts", "weight")


@register("momentum_select", f"WITH {base.MX}, g AS (SELECT asset, ts, lag(price, 1) OVER (PARTITION BY asset ORDER BY ts) / lag(price, 12) OVER (PARTITION BY asset ORDER BY ts) - 1 AS mom, dense_rank() OVER (ORDER BY ts) AS d FROM mx), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY mom DESC, asset) AS rk FROM g WHERE mom IS NOT NULL AND d % 3 = 1) SELECT asset, ts, rk::INT AS rk FROM k WHERE rk <= 10")
def momentum_select(spark, sf_dir):
    m, w = _m(spark, sf_dir), Window.partitionBy("asset").orderBy("ts")
    dates = X.rebalance_grid(m, "ts", 3, [0]).select("ts")
    g = m.withColumn("mom", F.lag("price", 1).over(w) / F.lag("price", 12).over(w) - 1).where("mom is not null").join(dates, "ts")
    return g.withColumn("rk", X.place(B, F.desc("mom"), col("asset"))).where("rk <= 10").select("asset", "ts", "rk")


@register("bucketise", f"WITH {base.MX} SELECT asset, ts, floor((row_number() OVER (PARTITION BY ts ORDER BY price, asset) - 1) * 10 / count(*) OVER (PARTITION BY ts))::INT AS bucket FROM mx")
def bucketise(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", X.bucketise("price", B, 10).alias("bucket"))


@register("rebalance_grid", f"WITH {base.MX}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM mx)) SELECT o::INT AS \"offset\", ts FROM d, range(0, 4) t(o) WHERE i >= o AND (i - o) % 4 = 0")
def rebalance_grid(spark, sf_dir):
    return X.rebalance_grid(_m(spark, sf_dir), "ts", 4, [0, 1, 2, 3])


@register("cross_zscore", f"WITH {base.MX} SELECT asset, ts, round(greatest(-3.0, least(3.0, CASE WHEN stddev_samp(price) OVER g > 0 THEN (price - avg(price) OVER g) / stddev_samp(price) OVER g END)), 6) + 0.0 AS z FROM mx WINDOW g AS (PARTITION BY ts)")
def cross_zscore(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", (F.round(X.zscore("price", B, 3.0), 6) + 0.0).alias("z"))


@register("sort_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderdate")


@register("liquidity_tercile", f"WITH {base.MX} SELECT asset, ts, ceil(3.0 * row_number() OVER (PARTITION BY ts ORDER BY qty, asset) / count(*) OVER (PARTITION BY ts))::INT AS tercile FROM mx")
def liquidity_tercile(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", F.ceil(3.0 * X.place(B, col("qty"), col("asset")) / F.count("*").over(Window.partitionBy("ts"))).cast("int").alias("tercile"))


# ---------------------------------------------------------------- eligibility


@register("eligibility", f"WITH {base.MX} SELECT asset, ts, CASE WHEN n < 2 THEN 'history' WHEN qty < 40 THEN 'turnover' WHEN disc < 0.03 THEN 'volatility' END AS reason FROM mx")
def eligibility(spark, sf_dir):
    return _m(spark, sf_dir).select("asset", "ts", F.when(col("n") < 2, "history").when(col("qty") < 40, "turnover").when(col("disc") < 0.03, "volatility").alias("reason"))


@register("min_group", f"WITH {_SECTOR} SELECT asset, ts, sector FROM s QUALIFY count(*) OVER (PARTITION BY ts, sector) >= 18")
def min_group(spark, sf_dir):
    return sectors(spark, sf_dir).withColumn("k", F.count("*").over(Window.partitionBy("ts", "sector"))).where("k >= 18").select("asset", "ts", "sector")


@register("stride_filter", f"WITH {base.HB} SELECT asset, ts, close FROM hb WHERE (idx - 1) % 5 = 0")
def stride_filter(spark, sf_dir):
    return base.hourly_basics(spark, sf_dir).where("(idx - 1) % 5 = 0").select("asset", "ts", "close")


@register("complete_case", f"WITH {_SECTOR} SELECT asset, ts, round(r, 6) + 0.0 AS r FROM s WHERE r IS NOT NULL AND isfinite(r) AND disc > 0")
def complete_case(spark, sf_dir):
    return sectors(spark, sf_dir).dropna(subset=["r"]).where("abs(r) < double('infinity') and not isnan(r) and disc > 0").select("asset", "ts", (F.round("r", 6) + 0.0).alias("r"))


@register("discontinuity_latch", f"WITH {base.HB}, f AS (SELECT *, coalesce(lr > ln(10.0), false) AS jump, lag(open) OVER o AS po FROM hb WINDOW o AS (PARTITION BY asset ORDER BY ts)) SELECT asset, ts, (max(jump::INT) OVER u = 1) AS broken, round(CASE WHEN max(jump::INT) OVER u = 1 THEN first(CASE WHEN jump THEN po END IGNORE NULLS) OVER u ELSE open END, 6) AS mark FROM f WINDOW u AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def discontinuity_latch(spark, sf_dir):
    """From the first jump above ln 10 on the series is broken for good: its mark stays at the open before the jump."""
    w = Window.partitionBy("asset").orderBy("ts")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    f = base.hourly_basics(spark, sf_dir).withColumn("jump", F.coalesce(col("lr") > F.log(F.lit(10.0)), F.lit(False))).withColumn("po", F.lag("open").over(w))
    broken = F.max("jump").over(u)
    return f.select("asset", "ts", broken.alias("broken"), F.round(F.when(broken, F.first(F.when(col("jump"), col("po")), ignorenulls=True).over(u)).otherwise(col("open")), 6).alias("mark"))


@register("gap_segments", f"WITH {base.HB}, g AS (SELECT asset, ts, close, coalesce(epoch(ts) - epoch(lag(ts) OVER o) > 7200, false)::INT AS gap FROM hb WINDOW o AS (PARTITION BY asset ORDER BY ts)), s AS (SELECT *, sum(gap) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT asset, ts, segment::BIGINT AS segment, round(ln(close / lag(close, 3) OVER (PARTITION BY asset, segment ORDER BY ts)), 6) + 0.0 AS ret_3 FROM s")
def gap_segments(spark, sf_dir):
    """A gap starts a segment; windows restart in it (logret_k in its own segment)."""
    w = Window.partitionBy("asset").orderBy("ts")
    seconds = F.unix_seconds(col("ts").cast("timestamp"))
    s = base.hourly_basics(spark, sf_dir).withColumn("gap", F.coalesce((seconds - F.lag(seconds).over(w) > 7200).cast("int"), F.lit(0)))
    s = s.withColumn("segment", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    from ..operators.windows import Trailing

    return s.select("asset", "ts", "segment", (F.round(Trailing("asset", "segment").logret(3), 6) + 0.0).alias("ret_3"))


# ---------------------------------------------------------------- labels


@register("fwd_return_bps", f"WITH {base.HB} SELECT a.asset, a.ts, round(1e4 * ln(b.close / a.close), 4) + 0.0 AS fwd_1h, round(1e4 * ln(c.close / a.close), 4) + 0.0 AS fwd_6h FROM hb a LEFT JOIN hb b ON a.asset = b.asset AND b.ts = a.ts + INTERVAL 1 HOUR LEFT JOIN hb c ON a.asset = c.asset AND c.ts = a.ts + INTERVAL 6 HOUR")
def fwd_return_bps(spark, sf_dir):
    b = base.hourly(spark, sf_dir)
    out = forward_exact(forward_exact(b, ["asset"], "ts", 3600, "close", "c1"), ["asset"], "ts", 6 * 3600, "close", "c6")
    return out.select("asset", "ts", *((F.round(1e4 * F.log(col(f"c{h}") / col("close")), 4) + 0.0).alias(f"fwd_{h}h") for h in (1, 6)))


@register("lagged_hold_return", f"WITH {base.HB} SELECT a.asset, a.ts, round(c.open / b.open - 1, 6) + 0.0 AS label FROM hb a LEFT JOIN hb b ON a.asset = b.asset AND b.ts = a.ts + INTERVAL 1 HOUR LEFT JOIN hb c ON a.asset = c.asset AND c.ts = a.ts + INTERVAL 8 HOUR")
def lagged_hold_return(spark, sf_dir):
    b = base.hourly(spark, sf_dir)
    out = forward_exact(forward_exact(b, ["asset"], "ts", 3600, "open", "o1"), ["asset"], "ts", 8 * 3600, "open", "o8")
    return out.select("asset", "ts", (F.round(col("o8") / col("o1") - 1, 6) + 0.0).alias("label"))


_LBL = f"{base.DB}, l AS (SELECT asset, ts, lead(open, 6) OVER w / lead(open, 1) OVER w - 1 AS label, stddev_pop(r1) OVER (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING) AS vol FROM db WINDOW w AS (PARTITION BY asset ORDER BY ts))"


def labels(spark, sf_dir):
    w = Window.partitionBy("asset").orderBy("ts")
    return base.daily_basics(spark, sf_dir).select("asset", "ts", (F.lead("open", 6).over(w) / F.lead("open", 1).over(w) - 1).alias("label"), F.stddev_pop("r1").over(w.rowsBetween(-19, 0)).alias("vol"))


def _label_query(name, sql, f):
    @register(name, f"WITH {_LBL} SELECT asset, ts, round({sql}, 6) + 0.0 AS y FROM l")
    def query(spark, sf_dir):
        return labels(spark, sf_dir).select("asset", "ts", (F.round(f(Window.partitionBy("ts")), 6) + 0.0).alias("y"))


_label_query("session_forward_return", "label", lambda w: col("label"))
_label_query("demean_label", "CASE WHEN count(label) OVER (PARTITION BY ts) >= 3 THEN label - avg(label) OVER (PARTITION BY ts) END", lambda w: F.when(F.count("label").over(w) >= 3, col("label") - F.avg("label").over(w)))
_label_query("per_risk_label", "CASE WHEN vol > 0 THEN (label - avg(label) OVER (PARTITION BY ts)) / vol END", lambda w: F.when(col("vol") > 0, (col("label") - F.avg("label").over(w)) / col("vol")))
_label_query("rank_label", _norm("label"), lambda w: X.rank_normalise("label", B))
_label_query("direction_label", "sign(avg(label) OVER (PARTITION BY ts))", lambda w: F.signum(F.avg("label").over(w)))
_label_query("sample_weight", "1.0 / count(*) OVER (PARTITION BY ts)", lambda w: 1 / F.count("*").over(w))


@register("winsorise", f"WITH {_LBL}, q AS (SELECT quantile_cont(label, 0.05) AS a, quantile_cont(label, 0.95) AS b FROM l WHERE ts < TIMESTAMP '2000-01-01') SELECT asset, ts, round(greatest(a, least(b, label)), 6) + 0.0 AS y FROM l, q WHERE label IS NOT NULL")
def winsorise(spark, sf_dir):
    """Clipped at the quantiles of the training rows (one row of bounds)."""
    rows = labels(spark, sf_dir).where("label is not null")
    q = quantiles(rows.where(col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")), [], "label", {"a": 0.05, "b": 0.95}).select("a", "b")
    return rows.join(F.broadcast(q)).select("asset", "ts", (F.round(F.greatest("a", F.least("b", "label")), 6) + 0.0).alias("y"))


@register("label_coverage", f"WITH {_LBL} SELECT asset, count(*) AS total, count(label) AS observed, count(*) FILTER (label IS NULL AND vol IS NOT NULL) AS without_exit FROM l GROUP BY 1")
def label_coverage(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("total"), F.count("label").alias("observed"), F.count_if(col("label").isNull() & col("vol").isNotNull()).alias("without_exit"))


@register("purged_folds", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), f AS (SELECT k::INT AS fold, DATE '1996-01-01' + (k * 365)::INT AS a, DATE '1996-01-01' + ((k + 1) * 365)::INT AS b FROM range(0, 5) t(k)) SELECT fold, CASE WHEN day >= a AND day < b THEN 'test' WHEN day <= a - 2 THEN 'train' END AS part, count(*) AS days FROM d, f WHERE day <= a - 2 OR (day >= a AND day < b) GROUP BY 1, 2")
def purged_folds(spark, sf_dir):
    """Expanding folds: train until two days before the test block; a row is in at most one test block."""
    days = table(spark, sf_dir, "orders").select(col("o_orderdate").cast("date").alias("day")).distinct()
    x = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("a", F.expr("date_add(date'1996-01-01', fold * 365)")).withColumn("b", F.expr("date_add(a, 365)"))
    part = F.when((col("day") >= col("a")) & (col("day") < col("b")), "test").when(col("day") <= F.date_sub("a", 2), "train")
    return x.withColumn("part", part).where("part is not null").groupBy("fold", "part").agg(F.count("*").alias("days"))


@register("assert_no_overlap", "WITH w AS (SELECT o_custkey AS fold, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT fold, coalesce(a <= max(b) OVER (ORDER BY a, fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM w")
def assert_no_overlap(spark, sf_dir):
    """The running maximum of earlier ends comes in two levels, within the day of the start and then over the days."""
    w = table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("fold")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).withColumn("day", col("a").cast("date"))
    earlier = lambda x, w: F.max(x).over(w.rowsBetween(Window.unboundedPreceding, -1))
    days = w.groupBy("day").agg(F.max("b").alias("last")).select("day", earlier("last", Window.orderBy("day")).alias("carried"))
    before = F.greatest(earlier("b", Window.partitionBy("day").orderBy("a", "fold")), "carried")
    return w.join(days, "day").select("fold", F.coalesce(col("a") <= before, F.lit(False)).alias("overlaps"))


@register("triple_barrier", f"""WITH {base.HB}, s AS (SELECT asset, ts, close, avg(tr) OVER (PARTITION BY asset ORDER BY ts ROWS 13 PRECEDING) AS atr, idx FROM hb), e AS (SELECT *, close - 0.5 * atr AS stop, close + 0.6 * atr AS target FROM s WHERE idx >= 14),
  p AS (SELECT e.asset, e.ts, b.ts AS at_, CASE WHEN b.low <= stop THEN least(b.open, stop) WHEN b.high >= target THEN greatest(b.open, target) END AS px, CASE WHEN b.low <= stop THEN 'stop' WHEN b.high >= target THEN 'target' END AS kind, b.close AS bc FROM e JOIN hb b ON e.asset = b.asset AND b.ts > e.ts AND b.ts <= e.ts + INTERVAL 6 HOUR)
  SELECT asset, ts, coalesce(arg_min(kind, at_) FILTER (kind IS NOT NULL), 'horizon') AS kind, round(coalesce(arg_min(px, at_) FILTER (kind IS NOT NULL), arg_max(bc, at_)), 6) AS exit_price FROM p GROUP BY 1, 2""")
def triple_barrier(spark, sf_dir):
    """First bar of the path that touches the stop (looked at first) or the target; gaps fill at the open, else the last close."""
    bars = base.hourly_basics(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(-13, 0)
    us = F.unix_micros(col("ts").cast("timestamp"))
    e = bars.select("asset", "ts", "idx", (col("close") - 0.5 * F.avg("tr").over(w)).alias("stop"), (col("close") + 0.6 * F.avg("tr").over(w)).alias("target")).where("idx >= 14")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("at", us + col("k").cast("long") * 3_600_000_000)
    p = e.join(bars.select("asset", us.alias("at"), "open", "high", "low", "close"), ["asset", "at"])
    kind = F.when(col("low") <= col("stop"), "stop").when(col("high") >= col("target"), "target")
    px = F.when(col("low") <= col("stop"), F.least("open", "stop")).when(col("high") >= col("target"), F.greatest("open", "target"))
    hit = F.when(kind.isNotNull(), col("at"))
    g = p.groupBy("asset", "ts").agg(F.min_by(kind, hit).alias("kind"), F.min_by(px, hit).alias("px"), F.max_by("close", "at").alias("last"), F.count(hit).alias("hits"))
    return g.select("asset", "ts", F.when(col("hits") > 0, col("kind")).otherwise("horizon").alias("kind"), F.round(F.when(col("hits") > 0, col("px")).otherwise(col("last")), 6).alias("exit_price"))


@register("training_matrix_crypto", f"WITH {_LBL}, x AS (SELECT d.asset, d.ts, d.close / lag(d.close, 30) OVER o - 1 AS ret_30, stddev_samp(d.lr) OVER (PARTITION BY d.asset ORDER BY d.ts ROWS 29 PRECEDING) AS vol_30, count(d.lr) OVER (PARTITION BY d.asset ORDER BY d.ts ROWS 29 PRECEDING) AS c FROM db d WINDOW o AS (PARTITION BY d.asset ORDER BY d.ts)), j AS (SELECT x.*, l.label FROM x JOIN l USING (asset, ts) WHERE c = 30 AND label IS NOT NULL AND ret_30 IS NOT NULL) SELECT asset, ts, round({_norm('ret_30')}, 6) + 0.0 AS ret_30, round({_norm('vol_30')}, 6) + 0.0 AS vol_30, round(label - avg(label) OVER (PARTITION BY ts), 6) + 0.0 AS y, round(1.0 / count(*) OVER (PARTITION BY ts), 6) AS weight FROM j")
def training_matrix_crypto(spark, sf_dir):
    from ..operators.windows import Trailing

    t = Trailing("asset")
    x = base.daily_basics(spark, sf_dir).select("asset", "ts", t.ret(30).alias("ret_30"), t.vol(30, per_year=1.0).alias("vol_30"))
    j = x.join(labels(spark, sf_dir), ["asset", "ts"]).dropna(subset=["ret_30", "vol_30", "label"])
    w = Window.partitionBy("ts")
    return j.select("asset", "ts", *base.rounded({k: X.rank_normalise(k, B) for k in ("ret_30", "vol_30")}), (F.round(col("label") - F.avg("label").over(w), 6) + 0.0).alias("y"), F.round(1 / F.count("*").over(w), 6).alias("weight"))
