"""Queries for sequential folds, models and streams."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artefacts as MA
from ..operators import folds as O
from ..operators import models as M
from ..registry import register
from ..sources.staging import shared_path
from ..streaming import stateful as SF
from ..streaming import streams as ST
from . import base
from .base import ntz, table
from .q_aggregates import sectors
from .q_cross import _LBL, labels
from .q_stats import _DRIFT, _SMALL, _W, _drift, small, weights

col = F.col
A = O.cascade_alpha(144)


@register("ema_cascade", f"""WITH RECURSIVE {base.DB}, s AS (
  SELECT asset, idx, ts, (high + low + close) / 3 AS p1, (high + low + close) / 3 AS p2, (high + low + close) / 3 AS p3, (high + low + close) / 3 AS p4 FROM db WHERE idx = 1
  UNION ALL SELECT b.asset, b.idx, b.ts, {A} * v + {1 - A} * p1, {A} * ({A} * v + {1 - A} * p1) + {1 - A} * p2,
    {A} * ({A} * ({A} * v + {1 - A} * p1) + {1 - A} * p2) + {1 - A} * p3, {A} * ({A} * ({A} * ({A} * v + {1 - A} * p1) + {1 - A} * p2) + {1 - A} * p3) + {1 - A} * p4
  FROM s JOIN (SELECT *, (high + low + close) / 3 AS v FROM db) b ON s.asset = b.asset AND b.idx = s.idx + 1)
  SELECT asset, ts, round(CASE WHEN idx >= 144 THEN p4 END, 4) AS filter FROM s""")
def ema_cascade(spark, sf_dir):
    return O.ema_cascade(base.daily_basics(spark, sf_dir), "asset", "ts").select("asset", "ts", F.round("filter", 4).alias("filter"))


def _poles(name: str, value: str) -> str:
    """SQL of four chained averages after one more value."""
    out, last = [], value
    for k in range(1, 5):
        last = f"({A} * {last} + {1 - A} * s.{name}{k})"
        out.append(f"{last} AS {name}{k}")
    return ", ".join(out)


_FIRST = ", ".join(f"{v} AS {n}{k}" for n, v in (("p", "(high + low + close) / 3"), ("q", "tr")) for k in range(1, 5))


@register("channel_geometry", f"""WITH RECURSIVE {base.DB}, s AS (
  SELECT asset, idx, ts, close, {_FIRST} FROM db WHERE idx = 1
  UNION ALL SELECT b.asset, b.idx, b.ts, b.close, {_poles('p', '((b.high + b.low + b.close) / 3)')}, {_poles('q', 'b.tr')} FROM s JOIN db b ON s.asset = b.asset AND b.idx = s.idx + 1),
  f AS (SELECT *, CASE WHEN idx >= 144 THEN p4 END AS f, CASE WHEN idx >= 144 THEN p4 + 1.414 * q4 END AS u, CASE WHEN idx >= 144 THEN p4 - 1.414 * q4 END AS l FROM s)
  SELECT asset, ts, round((u - l) / f, 6) AS band_width, round((close - u) / abs(u), 6) AS dist_upper, round((close - l) / abs(l), 6) AS dist_lower, round(f / lag(f, 20) OVER (PARTITION BY asset ORDER BY ts) - 1, 6) AS slope FROM f""")
def channel_geometry(spark, sf_dir):
    """Band width, distances to the bands, and slope over 20 bars."""
    d = base.daily_basics(spark, sf_dir)
    x = O.ema_cascade(d, "asset", "ts").join(d.select("asset", "ts", "close"), ["asset", "ts"])
    slope = col("filter") / F.lag("filter", 20).over(Window.partitionBy("asset").orderBy("ts")) - 1
    return x.select("asset", "ts", F.round((col("upper") - col("lower")) / col("filter"), 6).alias("band_width"), F.round((col("close") - col("upper")) / F.abs("upper"), 6).alias("dist_upper"), F.round((col("close") - col("lower")) / F.abs("lower"), 6).alias("dist_lower"), F.round(slope, 6).alias("slope"))


@register("wilder_atr", f"WITH RECURSIVE {base.DB}, s AS (SELECT d.asset, 14 AS idx, d.ts, m.a AS atr FROM db d JOIN (SELECT asset, avg(tr) AS a FROM db WHERE idx <= 14 GROUP BY 1) m USING (asset) WHERE d.idx = 14 UNION ALL SELECT b.asset, b.idx, b.ts, (atr * 13 + b.tr) / 14 FROM s JOIN db b ON s.asset = b.asset AND b.idx = s.idx + 1) SELECT d.asset, d.ts, round(s.atr, 4) AS atr FROM db d LEFT JOIN s USING (asset, ts)")
def wilder_atr(spark, sf_dir):
    return O.wilder_atr(base.daily_basics(spark, sf_dir), ["asset"], "ts").withColumn("atr", F.round("atr", 4))


@register("atr_ema", f"WITH RECURSIVE {base.DB}, s AS (SELECT asset, idx, ts, tr AS atr FROM db WHERE idx = 1 UNION ALL SELECT b.asset, b.idx, b.ts, atr + (b.tr - atr) / 14 FROM s JOIN db b ON s.asset = b.asset AND b.idx = s.idx + 1) SELECT asset, ts, round(atr, 4) AS atr FROM s")
def atr_ema(spark, sf_dir):
    return O.atr_ema(base.daily_basics(spark, sf_dir), "asset", "ts").withColumn("atr", F.round("atr", 4))


_SESSION = f"WITH {base.HB0}, h AS (SELECT *, ts::DATE AS session FROM hb0), x AS (SELECT *, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap, row_number() OVER (PARTITION BY asset, session ORDER BY ts) - 1 AS slot, first(open) OVER w AS s_open FROM h WINDOW w AS (PARTITION BY asset, session ORDER BY ts ROWS UNBOUNDED PRECEDING))"


@register("session_vwap_slot", f"{_SESSION} SELECT asset, ts, slot::BIGINT AS slot, round(vwap, 6) AS vwap, round(s_open, 6) AS s_open FROM x")
def session_vwap_slot(spark, sf_dir):
    b = base.hourly(spark, sf_dir).withColumn("session", col("ts").cast("date"))
    return O.session_features(b, "asset", "session", "ts").select("asset", "ts", col("slot").cast("long").alias("slot"), F.round("vwap", 6).alias("vwap"), F.round("s_open", 6).alias("s_open"))


@register("noise_band", f"{_SESSION}, c AS (SELECT asset, session, lag(c) OVER (PARTITION BY asset ORDER BY session) AS pc FROM (SELECT asset, session, arg_max(close, ts) AS c FROM h GROUP BY 1, 2)), n AS (SELECT x.*, pc, CASE WHEN count(*) OVER k = 14 THEN avg(abs(close / s_open - 1)) OVER k END AS sigma FROM x JOIN c USING (asset, session) WINDOW k AS (PARTITION BY asset, slot ORDER BY session ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) SELECT asset, ts, round(sigma, 6) AS sigma, round(CASE WHEN pc IS NULL AND sigma IS NULL THEN NULL ELSE greatest(s_open, pc) * (1 + sigma) END, 6) AS ub, round(least(s_open, pc) * (1 - sigma), 6) + 0.0 AS lb FROM n")
def noise_band(spark, sf_dir):
    b = base.hourly(spark, sf_dir).withColumn("session", col("ts").cast("date"))
    return O.session_features(b, "asset", "session", "ts").select("asset", "ts", F.round("noise_sigma", 6).alias("sigma"), F.round("noise_ub", 6).alias("ub"), (F.round("noise_lb", 6) + 0.0).alias("lb"))


def _signals(spark, sf_dir):
    b = base.hourly_basics(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("ts")
    return b.select("asset", F.unix_seconds(col("ts").cast("timestamp")).alias("ts_s"), (col("r1") * 100).alias("pred_bps"), (F.lead("r1").over(w) * 100).alias("fwd_bps"), F.when(col("trades") > 1, F.lit(30.0)).alias("cost_bps")).where("pred_bps is not null and fwd_bps is not null")


def _cooldown_sql(release: str) -> str:
    """Each opening leads to the first one at or after its release."""
    return f"""WITH RECURSIVE {base.HB}, s AS (SELECT asset, epoch(ts)::BIGINT AS ts_s, r1 * 100 AS pred, lead(r1) OVER (PARTITION BY asset ORDER BY ts) * 100 AS fwd, CASE WHEN trades > 1 THEN 30.0 END AS cost FROM hb),
  c AS (SELECT *, ts_s + {release} AS e FROM s WHERE pred IS NOT NULL AND fwd IS NOT NULL AND abs(pred) > cost),
  n AS (SELECT a.asset, a.ts_s, min(b.ts_s) AS nxt FROM c a JOIN c b ON a.asset = b.asset AND b.ts_s >= a.e GROUP BY 1, 2),
  t AS (SELECT asset, min(ts_s) AS ts_s FROM c GROUP BY 1 UNION ALL SELECT t.asset, n.nxt FROM t JOIN n USING (asset, ts_s))
  SELECT asset, ts_s, sign(pred)::INT AS side, round(sign(pred) * fwd - cost, 6) AS net_bps FROM t JOIN c USING (asset, ts_s)"""


@register("cooldown_trades", _cooldown_sql("21600"))
def cooldown_trades(spark, sf_dir):
    return O.cooldown_trades(_signals(spark, sf_dir), "asset", hold_s=6 * 3600).withColumn("net_bps", F.round("net_bps", 6))


@register("cooldown_trades_atr", _cooldown_sql("CASE WHEN abs(fwd) > 50 THEN 3600 ELSE 21600 END"))
def cooldown_trades_atr(spark, sf_dir):
    """Holds end early where the next bars' barrier releases them."""
    s = _signals(spark, sf_dir).withColumn("release", col("ts_s") + F.when(F.abs("fwd_bps") > 50, 3600).otherwise(6 * 3600))
    return O.cooldown_trades(s, "asset", release="release").withColumn("net_bps", F.round("net_bps", 6))


@register("waterfall_cap", f"""WITH RECURSIVE {_W}, b AS (SELECT asset, ts, sign(r) AS sg, least(0.1, abs(r) / 3) AS size, least(0.08, qty / 5000) AS cap FROM v),
  z AS (SELECT asset, ts, sg, cap, least(size, cap) AS kept, sum(size - least(size, cap)) OVER (PARTITION BY ts, sg) AS spill, 0 AS pass FROM b
    UNION ALL SELECT asset, ts, sg, cap, CASE WHEN spill > 0 AND total > 0 THEN kept + least(spill, total) * room / total ELSE kept END, CASE WHEN spill > 0 AND total > 0 THEN spill - least(spill, total) ELSE spill END, pass + 1
    FROM (SELECT *, greatest(cap - kept, 0) AS room, sum(greatest(cap - kept, 0)) OVER (PARTITION BY ts, sg) AS total FROM z WHERE pass < 8))
  SELECT ts, asset, round(sg * kept, 6) + 0.0 AS weight FROM z WHERE pass = 8""")
def waterfall_cap(spark, sf_dir):
    b = weights(spark, sf_dir).select("asset", "ts", (F.signum("r") * F.least(F.lit(0.1), F.abs("r") / 3)).alias("w"), F.least(F.lit(0.08), col("qty") / 5000).alias("cap"))
    return O.waterfall_cap(b, "ts", "asset", "w", "cap").withColumn("weight", F.round("weight", 6) + 0.0)


@register("net_cap", f"""WITH RECURSIVE {_W}, o AS (SELECT asset, ts, sign(r) * least(0.05, abs(r) / 5) AS w FROM v WHERE sign(r) * least(0.05, abs(r) / 5) <> 0),
  z AS (SELECT asset, ts, w, 0 AS k, true AS more FROM o
    UNION ALL SELECT asset, ts, CASE WHEN heavy THEN w * f ELSE w END, k + 1, abs(up - down) - 0.1 > 1e-12
    FROM (SELECT *, (least(up, down) + 0.1) / greatest(up, down) AS f, abs(up - down) - 0.1 > 1e-12 AND (w > 0) = (up > down) AS heavy
      FROM (SELECT *, coalesce(sum(w) FILTER (w > 0) OVER g, 0) AS up, -coalesce(sum(w) FILTER (w < 0) OVER g, 0) AS down FROM z WHERE more WINDOW g AS (PARTITION BY ts)))
    WHERE NOT heavy OR abs(w * f) + 1e-12 >= 0.002)
  SELECT ts, asset, round(w, 6) + 0.0 AS weight FROM z WHERE NOT more""")
def net_cap(spark, sf_dir):
    b = weights(spark, sf_dir).select("asset", "ts", (F.signum("r") * F.least(F.lit(0.05), F.abs("r") / 5)).alias("w")).where("w <> 0")
    return O.net_cap(b, "ts", "asset", "w", 0.1, 0.002).withColumn("weight", F.round("weight", 6) + 0.0)


@register("turnover_budget", _DRIFT.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, w * held < 0 OR abs(w) < abs(held) AS free, row_number() OVER (PARTITION BY ts ORDER BY abs(drift) DESC, asset) AS k FROM d),
  z AS (SELECT DISTINCT ts, 0::BIGINT AS k, 0.0::DOUBLE AS spent, 0::BIGINT AS asset, 0.0::DOUBLE AS drift, false AS keep FROM o
    UNION ALL SELECT o.ts, o.k, CASE WHEN NOT free AND spent + abs(o.drift) <= 0.5 THEN spent + abs(o.drift) ELSE spent END, o.asset, o.drift, free OR spent + abs(o.drift) <= 0.5 FROM z JOIN o ON o.ts = z.ts AND o.k = z.k + 1)
  SELECT ts, asset, round(drift, 6) + 0.0 AS drift FROM z WHERE keep""")
def turnover_budget(spark, sf_dir):
    d = _drift(spark, sf_dir).withColumn("free", (col("w") * col("held") < 0) | (F.abs("w") < F.abs("held")))
    return O.turnover_budget(d, "ts", "asset", "drift", "free", 0.5).withColumn("drift", F.round("drift", 6) + 0.0)


@register("direction_state", f"""WITH RECURSIVE {base.DB}, d AS (SELECT asset, ts, idx, greatest(-1.0, least(1.0, coalesce(avg(lr) OVER w5, 0.0))) AS score, coalesce(stddev_pop(lr) OVER w20, 0.0) AS vol FROM db
    WINDOW w5 AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), w20 AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  s AS (SELECT DISTINCT asset, 0::BIGINT AS idx, NULL::TIMESTAMP AS ts, 0 AS side, 0.0::DOUBLE AS g, 0.0::DOUBLE AS n FROM d
    UNION ALL SELECT asset, idx, ts, side, g2, CASE WHEN abs(cur) <= 1e-12 THEN 0.0 ELSE greatest(-g2, least(g2, b + greatest(-0.2, least(0.2, cur - b)))) END
    FROM (SELECT *, CASE WHEN n * cur < 0 THEN 0.0 ELSE n END AS b
    FROM (SELECT *, CASE WHEN wg > 1e-12 THEN wn / wg * g2 ELSE 0.0 END AS cur
    FROM (SELECT *, CASE WHEN wg < g THEN wg ELSE g + greatest(-0.2, least(0.2, wg - g)) END AS g2
    FROM (SELECT *, CASE lvl WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 ELSE 1.0 END::DOUBLE * scale AS wg, side * CASE lvl WHEN 0 THEN 0.0 WHEN 1 THEN 0.3 ELSE 0.6 END::DOUBLE * scale AS wn
    FROM (SELECT *, CASE WHEN side = 0 THEN 0 WHEN abs(score) >= 0.8 THEN 2 ELSE 1 END AS lvl, CASE WHEN vol <= 1e-12 THEN 1.0 ELSE least(1.0, 0.15 / vol) END AS scale
    FROM (SELECT s.asset, d.idx, d.ts, s.g, s.n, d.score, d.vol, CASE WHEN s.side = 0 THEN CASE WHEN score >= 0.4 THEN 1 WHEN score <= -0.4 THEN -1 ELSE 0 END WHEN s.side * score <= -0.4 THEN -s.side WHEN s.side * score <= 0 THEN 0 ELSE s.side END AS side
      FROM s JOIN d ON s.asset = d.asset AND d.idx = s.idx + 1)))))))
  SELECT asset, ts, side, round(g, 6) AS gross, round(n, 6) + 0.0 AS net FROM s WHERE idx > 0""")
def direction_state(spark, sf_dir):
    t = Window.partitionBy("asset").orderBy("ts")
    d = base.daily_basics(spark, sf_dir).select("asset", "ts", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.avg("lr").over(t.rowsBetween(-4, 0)), F.lit(0.0)))).alias("score"), F.coalesce(F.stddev_pop("lr").over(t.rowsBetween(-19, 0)), F.lit(0.0)).alias("vol"))
    return O.direction_state(d, "asset", "ts").select("asset", "ts", "side", F.round("gross", 6).alias("gross"), (F.round("net", 6) + 0.0).alias("net"))


@register("vol_target_overlay", f"""WITH RECURSIVE {_SMALL}, o AS (SELECT ts, r, row_number() OVER w AS k, CASE WHEN count(*) OVER p = 8 THEN stddev_samp(r) OVER p * sqrt(52.0) END AS v FROM x WINDOW w AS (ORDER BY ts), p AS (ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
  s AS (SELECT NULL::TIMESTAMP AS ts, 0::BIGINT AS k, 1.0::DOUBLE AS e, 1.0::DOUBLE AS eq, 1.0::DOUBLE AS peak
    UNION ALL SELECT ts, k, e, eq * (1 + e * r), greatest(peak, eq * (1 + e * r))
    FROM (SELECT o.ts, o.k, o.r, s.eq, s.peak, least(CASE WHEN v > 0 THEN least(1.0, 0.01 / v) ELSE 1.0 END, CASE WHEN s.eq / s.peak - 1 <= -0.05 THEN 0.5 ELSE 1.0 END) AS e FROM s JOIN o ON o.k = s.k + 1))
  SELECT 'all' AS book, ts, round(e, 6) AS exposure, round(eq, 6) AS equity FROM s WHERE k > 0""")
def vol_target_overlay(spark, sf_dir):
    return O.vol_target_overlay(small(spark, sf_dir).withColumn("book", F.lit("all")), "book", "ts", "r", 0.01, 0.05).withColumn("exposure", F.round("exposure", 6)).withColumn("equity", F.round("equity", 6))


# ---------------------------------------------------------------- models


def _matrix(spark, sf_dir):
    d = base.daily_basics(spark, sf_dir)
    t = Window.partitionBy("asset").orderBy("ts")
    x = d.select("asset", "ts", (col("close") / F.lag("close", 5).over(t) - 1).alias("x1"), F.avg("r1").over(t.rowsBetween(-9, 0)).alias("x2"))
    return x.join(labels(spark, sf_dir).select("asset", "ts", col("label").alias("y")), ["asset", "ts"]).dropna().withColumn("w", F.lit(1.0))


@register("fit_ridge", f"""WITH {_LBL}, x AS (SELECT asset, ts, close / lag(close, 5) OVER o - 1 AS x1, avg(r1) OVER (PARTITION BY asset ORDER BY ts ROWS 9 PRECEDING) AS x2 FROM db WINDOW o AS (PARTITION BY asset ORDER BY ts)),
  m AS (SELECT x.*, l.label AS y FROM x JOIN l USING (asset, ts) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND l.label IS NOT NULL),
  t AS (SELECT sum(x1 * x1) + 1 AS a, sum(x1 * x2) AS b, sum(x1) AS c, sum(x2 * x2) + 1 AS d, sum(x2) AS e, count(*)::DOUBLE AS n, sum(x1 * y) AS u, sum(x2 * y) AS v, sum(y) AS w FROM m),
  k AS (SELECT *, a * (d * n - e * e) - b * (b * n - e * c) + c * (b * e - d * c) AS det FROM t),
  f AS (SELECT (u * (d * n - e * e) - b * (v * n - e * w) + c * (v * e - d * w)) / det AS b1, (a * (v * n - e * w) - u * (b * n - e * c) + c * (b * w - v * c)) / det AS b2, (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det AS b0 FROM k)
  SELECT asset, ts, round(b0 + x1 * b1 + x2 * b2, 6) + 0.0 AS prediction FROM m, f""")
def fit_ridge(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.select("asset", "ts", F.round(M.linear_score(["x1", "x2"], M.fit_ridge(m, ["x1", "x2"], "y", "w", 1.0)), 6).alias("p")).select("asset", "ts", (col("p") + 0.0).alias("prediction"))


_THROUGH = "1998-12-31"


@register("fit_trees")
def fit_trees(spark, sf_dir):
    """A direction model of three seeds, its label winsorised, fitted up to a day and scoring the days after it."""
    m = _matrix(spark, sf_dir)
    model = MA.fit_tree_model(m, ["x1", "x2"], "y", "ts", _THROUGH, order=["asset", "ts"], clip_quantile=0.01)
    later = MA.score(m.where(col("ts").cast("date") > F.lit(_THROUGH).cast("date")), model, "ts")
    return later.select("asset", "ts", col("score").alias("prediction"), MA.direction_score("score", model).alias("direction"))


_TREES = [{"split_feature": 0, "threshold": 30000.0, "default_left": True, "left_child": {"leaf_value": -0.5}, "right_child": {"split_feature": 1, "threshold": 100.0, "default_left": False, "left_child": {"leaf_value": 0.25}, "right_child": {"leaf_value": 1.0}}}, {"split_feature": 2, "threshold": 0.05, "left_child": {"leaf_value": 0.1}, "right_child": {"leaf_value": -0.1}}]


@register("score_trees", f"WITH {base.MX} SELECT asset, ts, round(CASE WHEN price <= 30000 THEN -0.5 WHEN qty <= 100 THEN 0.25 ELSE 1.0 END + CASE WHEN disc <= 0.05 THEN 0.1 ELSE -0.1 END, 6) + 0.0 AS score FROM mx")
def score_trees(spark, sf_dir):
    return M.score_trees(base.monthly(spark, sf_dir), ["price", "qty", "disc"], json.dumps(_TREES)).select("asset", "ts", (F.round("score", 6) + 0.0).alias("score"))


_HYBRID = {"family": "hybrid", "features": ["price", "qty", "disc"], "weights": [1.37e-5, 0.0, 0.53, 0.1], "tree_weight": 0.45, "slope": 0.8, "offset": 0.02, "reward": "return_per_risk"}


@register("score_linear_hybrid", f"WITH {base.MX}, t AS (SELECT *, 0.55 * (1.37e-5 * price + 0.53 * disc + 0.1) + 0.45 * (CASE WHEN price <= 30000 THEN -0.5 WHEN qty <= 100 THEN 0.25 ELSE 1.0 END + CASE WHEN disc <= 0.05 THEN 0.1 ELSE -0.1 END) AS raw FROM mx) SELECT asset, ts, round(0.02 + 0.8 * raw * (1 + tax), 6) + 0.0 AS score, ts <= TIMESTAMP '1996-06-30' AS learned FROM t")
def score_linear_hybrid(spark, sf_dir):
    """A stored model per unit of risk, calibrated: one trained through mid-1996 scores what is later, one older than all rows the rest."""
    rows, out = base.monthly(spark, sf_dir).withColumn("risk", 1 + col("tax")), None
    for through, learned in (("1996-06-30", False), ("1900-01-01", True)):
        path = shared_path(spark, "model")
        MA.save(spark, MA.Model(**_HYBRID, trained_through=through, trees=_TREES), path)
        part = rows.where((col("ts").cast("date") <= F.lit("1996-06-30").cast("date")) == learned)
        part = MA.score(part, MA.load(spark, path), "ts", risk="risk").select("asset", "ts", (F.round("score", 6) + 0.0).alias("score"), F.lit(learned).alias("learned"))
        out = part if out is None else out.union(part)
    return out


@register("calibrate", "WITH o AS (SELECT l_discount AS p, l_tax * 0.5 + l_discount * 0.3 AS y FROM lineitem) SELECT round(greatest(0, least(1, covar_pop(p, y) / var_pop(p))), 6) AS slope, round(avg(y) - greatest(0, least(1, covar_pop(p, y) / var_pop(p))) * avg(p), 6) AS \"offset\" FROM o")
def calibrate(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(col("l_discount").alias("p"), (col("l_tax") * 0.5 + col("l_discount") * 0.3).alias("y"))
    return M.calibrate(o, "p", "y").select(F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset"))


@register("blend_models", f"WITH {base.MX} SELECT asset, ts, round(price / 3 + qty * 2 / 3, 5) AS blended FROM mx")
def blend_models(spark, sf_dir):
    return base.monthly(spark, sf_dir).select("asset", "ts", F.round(M.blend(["price", "qty"], [1, 2]), 5).alias("blended"))


# ---------------------------------------------------------------- streams (closed windows only)

_LATE = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@register("stream_resample", f"SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_min(value, {{'a': e.ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': e.ts, 'b': event_id}}) AS close, count(*) AS n FROM events e GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, min(e.ts)) + INTERVAL 5 MINUTE <= {_LATE}")
def stream_resample(spark, sf_dir):
    out = ST.run_available(ST.resample(ST.event_stream(spark, sf_dir), "event_type", "value", "5 minutes"), "resample")
    return out.withColumn("ts", ntz(col("ts")))


@register("stream_flow_minute", f"SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n_trades, round(sum(value), 6) AS notional FROM events GROUP BY 1, 2 HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= {_LATE}")
def stream_flow_minute(spark, sf_dir):
    out = ST.run_available(ST.flow_minute(ST.event_stream(spark, sf_dir), "event_type"), "flow")
    return out.select("event_type", ntz(col("minute")).alias("minute"), "n_trades", F.round("notional", 6).alias("notional"))


@register("stream_dedupe", "SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    e = ST.event_stream(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ST.run_available(ST.dedupe(twice, ["event_id"]).select("event_id", "user_id"), "dedupe")


def _delivered(spark, sf_dir, more=None):
    """The events in three deliveries by time; ``more`` adds rows that come once again, or late."""
    e = ST.time_slices(table(spark, sf_dir, "events").select("event_id", col("ts").cast("timestamp").alias("ts"), "user_id", "value"), "ts")
    return [SF.with_micros(e.where(col("slice") == k) if more is None else more(e, k)).drop("slice") for k in range(3)]


_SLICES = "x AS (SELECT *, epoch_us(ts) AS us FROM events), z AS (SELECT min(us) AS a, max(us) AS z FROM x)"
_MARK = "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)"


@register("stream_positions", """WITH f AS (SELECT user_id, list({'q': (1 + event_id % 3) * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE, 'p': value} ORDER BY ts, event_id) AS fs FROM events WHERE value IS NOT NULL GROUP BY 1),
  s AS (SELECT user_id, len(fs) AS fills, list_reduce(fs, lambda a, f: {'q': a.q + f.q, 'p': CASE WHEN a.q + f.q = 0 THEN 0.0 WHEN a.q = 0 OR sign(a.q) = sign(f.q) THEN (a.q * a.p + f.q * f.p) / (a.q + f.q) WHEN sign(a.q + f.q) <> sign(a.q) THEN f.p ELSE a.p END}, {'q': 0.0::DOUBLE, 'p': 0.0::DOUBLE}) AS s FROM f)
  SELECT user_id, s.q AS qty, round(s.p, 6) + 0.0 AS avg_price, fills FROM s""")
def stream_positions(spark, sf_dir):
    """Fills in three deliveries; every tenth is delivered twice at once, every seventh once more with the next delivery."""
    again = lambda e, k: e.where(col("slice") == k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(col("event_id") % 10 == 0, 2).otherwise(1)))).drop("copy").union(e.where((col("slice") == k - 1) & (col("event_id") % 7 == 0)))
    fills = [d.where("value is not null").select("user_id", "ts", "us", "event_id", ((1 + col("event_id") % 3) * F.when(col("event_id") % 2 == 0, 1.0).otherwise(-1.0)).alias("qty"), col("value").alias("price")) for d in _delivered(spark, sf_dir, again)]
    # The watermark trails by more than two deliveries, so that replays reach the processor.
    out, _ = ST.run_deliveries(fills, lambda s: SF.positions(s, "user_id", 4 * 86_400), "positions", watermark="40 days")
    return out.groupBy("user_id").agg(F.max_by(F.struct("qty", "avg_price", "fills"), "fills").alias("last")).select("user_id", "last.qty", (F.round("last.avg_price", 6) + 0.0).alias("avg_price"), "last.fills")


@register("stream_cooldown", f"""WITH RECURSIVE x AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events), c AS (SELECT * FROM x WHERE value > 30),
  n AS (SELECT a.user_id, a.us, a.event_id, min({{'us': b.us, 'id': b.event_id}}) AS nxt FROM c a JOIN c b ON a.user_id = b.user_id AND b.us >= a.us + 3600000000 GROUP BY 1, 2, 3),
  t AS (SELECT user_id, min({{'us': us, 'id': event_id}}) AS o FROM c GROUP BY 1 UNION ALL SELECT t.user_id, n.nxt FROM t JOIN n ON t.user_id = n.user_id AND t.o.us = n.us AND t.o.id = n.event_id),
  o AS (SELECT c.* FROM t JOIN c ON t.user_id = c.user_id AND t.o.id = c.event_id AND t.o.us = c.us), l AS (SELECT user_id, max(us) AS last FROM x GROUP BY 1)
  SELECT user_id, us, event_id, value, 'open' AS kind FROM o
  UNION ALL SELECT user_id, us + 3600000000, event_id, value, 'exit' FROM o JOIN l USING (user_id) WHERE us + 3600000000 <= last OR (us + 3600000000 + 999) // 1000 <= {_MARK}""")
def stream_cooldown(spark, sf_dir):
    """Holds of an hour over three deliveries: openings, and exits at their own time."""
    return ST.run_deliveries(_delivered(spark, sf_dir), lambda s: SF.cooldown(s, "user_id", 30.0, 3600), "cooldown")[0]


@register("stream_session_features", f"""WITH RECURSIVE {base.HB0}, z AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS z FROM hb0),
  p AS (SELECT hb0.*, ((epoch_us(ts) - a) * 3 / (z - a + 1))::DOUBLE AS f, hour(ts) = 5 AND day(ts) % 3 = 1 AS slow FROM hb0, z), d AS (SELECT *, floor(f) AS slice FROM p),
  g AS (SELECT *, slow AND EXISTS (SELECT 1 FROM d b WHERE b.asset = d.asset AND NOT b.slow AND b.ts > d.ts AND b.slice <= d.slice) AS late FROM d),
  hb AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr FROM (SELECT *, row_number() OVER o AS idx, lag(close) OVER o AS pc FROM g WHERE NOT late WINDOW o AS (PARTITION BY asset ORDER BY ts))),
  a AS (SELECT b.asset, 14 AS idx, b.ts, m.a AS atr FROM hb b JOIN (SELECT asset, avg(tr) AS a FROM hb WHERE idx <= 14 GROUP BY 1) m USING (asset) WHERE b.idx = 14 UNION ALL SELECT b.asset, b.idx, b.ts, (atr * 13 + b.tr) / 14 FROM a JOIN hb b ON a.asset = b.asset AND b.idx = a.idx + 1),
  h AS (SELECT *, ts::DATE AS session FROM hb), x AS (SELECT *, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap, row_number() OVER (PARTITION BY asset, session ORDER BY ts) - 1 AS slot, first(open) OVER w AS s_open FROM h WINDOW w AS (PARTITION BY asset, session ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT asset, session, lag(c) OVER (PARTITION BY asset ORDER BY session) AS pc FROM (SELECT asset, session, arg_max(close, ts) AS c FROM h GROUP BY 1, 2)),
  n AS (SELECT x.* EXCLUDE (pc), c.pc, CASE WHEN count(*) OVER k = 14 THEN avg(abs(close / s_open - 1)) OVER k END AS sigma FROM x JOIN c USING (asset, session) WINDOW k AS (PARTITION BY asset, slot ORDER BY session ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
  SELECT n.asset, epoch_us(n.ts) AS us, slot::BIGINT AS slot, round(vwap, 6) AS vwap, round(atr, 4) AS atr, round(sigma, 6) AS noise_sigma, round(CASE WHEN sigma IS NOT NULL THEN greatest(s_open, pc) * (1 + sigma) END, 6) AS noise_ub, round(least(s_open, pc) * (1 - sigma), 6) + 0.0 AS noise_lb, false AS late FROM n LEFT JOIN a USING (asset, ts)
  UNION ALL SELECT asset, epoch_us(ts), NULL, NULL, NULL, NULL, NULL, NULL, true FROM g WHERE late""")
def stream_session_features(spark, sf_dir):
    """Hourly bars in deliveries by time; some bars come one delivery late, and go to the side table."""
    bars = ST.time_slices(base.hourly(spark, sf_dir).withColumn("ts", col("ts").cast("timestamp")), "ts")
    slow = (F.hour("ts") == 5) & (F.dayofmonth("ts") % 3 == 1)
    bars = bars.withColumn("slice", col("slice") + slow.cast("int")).select("asset", "ts", F.unix_micros("ts").alias("us"), F.unix_date(col("ts").cast("date")).cast("long").alias("session"), "open", "high", "low", "close", "volume", "slice")
    on_time, late = ST.run_deliveries([bars.where(col("slice") == k).drop("slice") for k in range(4)], lambda s: SF.session_features(s, "asset"), "session", late="late")
    places = {"vwap": 6, "atr": 4, "noise_sigma": 6, "noise_ub": 6, "noise_lb": 6}
    return on_time.unionByName(late).select("asset", "us", "slot", *((F.round(k, n) + 0.0).alias(k) for k, n in places.items()), "late")


@register("stream_heartbeat", f"""WITH x AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, lag(us) OVER w AS last, lead(us) OVER w AS nxt FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us))
  SELECT user_id, us, 'live' AS status, last AS last_us FROM g WHERE last IS NULL OR us > last + 86400000000
  UNION ALL SELECT user_id, us + 86400000000, 'dead', us FROM g WHERE nxt > us + 86400000000 OR nxt IS NULL AND (us + 86400000001 + 999) // 1000 <= {_MARK}""")
def stream_heartbeat(spark, sf_dir):
    """Users silent for more than a day are told dead at that time, and live when they return."""
    return ST.run_deliveries(_delivered(spark, sf_dir), lambda s: SF.heartbeat(s, "user_id", 86_400), "heartbeat")[0]


@register("file_stream_source", "SELECT event_id, CASE WHEN event_id % 50 IN (7, 8) THEN 'malformed' WHEN event_id % 50 = 9 THEN 'incomplete' END AS reason, CASE WHEN event_id % 50 NOT IN (7, 8, 9) THEN value END AS value FROM events WHERE value IS NOT NULL")
def file_stream_source(spark, sf_dir):
    """Events as JSON lines in two deliveries, read with a strict schema: lines cut off or of a wrong type, and lines without a value, go to a side table."""
    path = shared_path(spark, "json")
    k = col("event_id") % 50
    e = table(spark, sf_dir, "events").where("value is not null")
    line = F.to_json(F.struct("event_id", "user_id", F.when(k != 9, col("value")).alias("value")))
    line = F.when(k == 7, F.substring(line, 1, 20)).when(k == 8, F.replace(line, F.lit('"user_id":'), F.lit('"user_id":"x",'))).otherwise(line)
    for part in range(2):
        e.where(F.pmod("event_id", F.lit(2)) == part).select(line.alias("value")).write.mode("append").text(f"{path}/in")
        good, bad = ST.quarantined(ST.json_stream(spark, f"{path}/in", "event_id long, user_id long, value double"), path)
    wrong = bad.select(F.regexp_extract("raw", r'"event_id":([0-9]+)', 1).cast("long").alias("event_id"), "reason", F.lit(None).cast("double").alias("value"))
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), "value").unionByName(wrong)
