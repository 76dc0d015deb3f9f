"""Queries for evaluation statistics, costs, weights and profit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import statistics as S
from ..operators import cross_section as X
from ..operators.quantiles import quantiles
from ..registry import register
from . import base
from .base import ntz, table
from .q_aggregates import _SECTOR, sectors
from .q_cross import _avg_rank

col = F.col
_RET = f"{base.DB}, d AS (SELECT ts, avg(r1) FILTER (asset <> 'P1') AS r, avg(r1) FILTER (asset = 'P1') AS b FROM db GROUP BY 1 HAVING avg(r1) FILTER (asset <> 'P1') IS NOT NULL)"
#: Daily returns of the random tables are large; a hundredth of them keeps every product positive.
_SMALL = f"{_RET}, x AS (SELECT ts, r / 1000 AS r, b / 1000 AS b FROM d)"


def small(spark, sf_dir):
    d = base.daily_basics(spark, sf_dir)
    other = F.avg(F.when(col("asset") != "P1", col("r1")))
    return d.groupBy("ts").agg(other.alias("r"), F.avg(F.when(col("asset") == "P1", col("r1"))).alias("b")).where("r is not null").select("ts", (col("r") / 1000).alias("r"), (col("b") / 1000).alias("b"))


_IC = f"WITH {_SECTOR}, y AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM s), k AS (SELECT ts, sector, {{a}} AS a, {{b}} AS b FROM y WHERE r IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT ts, corr(a, b) AS ic, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 10)".format(a=_avg_rank("r"), b=_avg_rank("fwd"))


def ic_rows(spark, sf_dir):
    y = sectors(spark, sf_dir).withColumn("fwd", F.lead("r").over(Window.partitionBy("asset").orderBy("ts"))).where("r is not null and fwd is not null")
    return S.rank_ic(y, ["ts"], "r", "fwd", 10)


@register("spearman_rank_ic", f"{_IC} SELECT ts, round(ic, 6) + 0.0 AS ic, n FROM i")
def spearman_rank_ic(spark, sf_dir):
    return ic_rows(spark, sf_dir).select("ts", (F.round("ic", 6) + 0.0).alias("ic"), "n")


@register("ic_by_period", f"{_IC} SELECT count(ic) AS periods, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic) / 2.0), 6) + 0.0 AS t, round(avg((ic > 0)::INT), 6) AS hit FROM i")
def ic_by_period(spark, sf_dir):
    return S.ic_summary(ic_rows(spark, sf_dir), overlap=2.0)


@register("feature_ic_table", f"WITH {_SECTOR}, y AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM s), f AS (SELECT ts, fwd, asset, 'r' AS feature, r AS v FROM y UNION ALL SELECT ts, fwd, asset, 'qty', qty FROM y UNION ALL SELECT ts, fwd, asset, 'disc', disc FROM y), k AS (SELECT ts, feature, {_avg_rank('v', 'ts, feature')} AS a, {_avg_rank('fwd', 'ts, feature')} AS b FROM f WHERE v IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT ts, feature, corr(a, b) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 10) SELECT feature, count(ic) AS dates, count(*) FILTER (ic > 0) AS positive, round(avg(ic), 6) + 0.0 AS mean_ic FROM i GROUP BY 1")
def feature_ic_table(spark, sf_dir):
    y = sectors(spark, sf_dir).withColumn("fwd", F.lead("r").over(Window.partitionBy("asset").orderBy("ts")))
    f = y.select("ts", "asset", "fwd", "r", "qty", "disc").unpivot(["ts", "asset", "fwd"], ["r", "qty", "disc"], "feature", "v").where("v is not null and fwd is not null")
    i = S.rank_ic(f, ["ts", "feature"], "v", "fwd", 10)
    return i.groupBy("feature").agg(F.count("ic").alias("dates"), F.count_if(col("ic") > 0).alias("positive"), (F.round(F.avg("ic"), 6) + 0.0).alias("mean_ic"))


@register("ic_screen_event", f"WITH {_SECTOR}, y AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM s), q AS (SELECT quantile_cont(abs(r), 0.9) AS p FROM y WHERE fwd IS NOT NULL) SELECT CASE WHEN abs(r) > p THEN 'moved' ELSE 'quiet' END AS kind, count(*) AS n, round(corr(r, fwd), 6) + 0.0 AS ic FROM y, q WHERE r IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def ic_screen_event(spark, sf_dir):
    y = sectors(spark, sf_dir).withColumn("fwd", F.lead("r").over(Window.partitionBy("asset").orderBy("ts"))).where("r is not null and fwd is not null")
    q = quantiles(y, [], F.abs("r"), {"p": 0.9}).select("p")
    return y.join(F.broadcast(q)).groupBy(F.when(F.abs("r") > col("p"), "moved").otherwise("quiet").alias("kind")).agg(F.count("*").alias("n"), (F.round(F.corr("r", "fwd"), 6) + 0.0).alias("ic"))


@register("prediction_diagnostics", f"WITH {_SECTOR}, y AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM s), k AS (SELECT *, floor((row_number() OVER (PARTITION BY ts ORDER BY r, asset) - 1) * 10 / count(*) OVER (PARTITION BY ts))::INT AS bucket FROM y WHERE r IS NOT NULL AND fwd IS NOT NULL) SELECT bucket, count(*) AS n, round(avg(fwd), 6) + 0.0 AS outcome, round(avg(abs(r - fwd)), 6) AS mae, round(avg((sign(r) = sign(fwd))::INT), 6) AS accuracy FROM k GROUP BY 1")
def prediction_diagnostics(spark, sf_dir):
    y = sectors(spark, sf_dir).withColumn("fwd", F.lead("r").over(Window.partitionBy("asset").orderBy("ts"))).where("r is not null and fwd is not null")
    return y.withColumn("bucket", X.bucketise("r", ["ts"], 10)).groupBy("bucket").agg(F.count("*").alias("n"), (F.round(F.avg("fwd"), 6) + 0.0).alias("outcome"), F.round(F.avg(F.abs(col("r") - col("fwd"))), 6).alias("mae"), F.round(F.avg((F.signum("r") == F.signum("fwd")).cast("int")), 6).alias("accuracy"))


@register("magnitude_quantiles", f"WITH {base.HB} SELECT asset, round(quantile_cont(abs(r1), 0.5), 6) AS p50, round(quantile_cont(abs(r1), 0.9), 6) AS p90, round(quantile_cont(abs(r1), 0.99), 6) AS p99 FROM hb GROUP BY 1")
def magnitude_quantiles(spark, sf_dir):
    return base.hourly_basics(spark, sf_dir).groupBy("asset").agg(*(F.round(F.percentile(F.abs("r1"), p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)))


_NAV = f"WITH {_SMALL}, n AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY ts)) AS nav FROM x), k AS (SELECT *, nav / max(nav) OVER (ORDER BY ts) - 1 AS dd FROM n)"


@register("nav_metrics", f"{_NAV} SELECT count(*) AS steps, round(arg_max(nav, ts) - 1, 6) AS total_return, round(pow(arg_max(nav, ts), 365.0 / count(*)) - 1, 6) AS cagr, round(stddev_samp(r) * sqrt(365.0), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(365.0), 6) AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown, count(*) < 60 AS insufficient FROM k")
def nav_metrics(spark, sf_dir):
    return S.nav_metrics(small(spark, sf_dir), "ts", "r", 365.0)


@register("return_metrics", f"{_NAV} SELECT round(exp(avg(ln(1 + r)) * 252) - 1, 6) AS annual, round(stddev_pop(r) * sqrt(252.0), 6) AS vol, round((avg(r) - 0.00008) / stddev_pop(r) * sqrt(252.0), 6) AS sharpe, round(sqrt((1 + 0.5 * pow((avg(r) - 0.00008) / stddev_pop(r), 2)) / count(*)) * sqrt(252.0), 6) AS sharpe_se FROM k")
def return_metrics(spark, sf_dir):
    x = (F.avg("r") - 0.00008) / F.stddev_pop("r")
    return small(spark, sf_dir).agg(F.round(F.exp(F.avg(F.log1p("r")) * 252) - 1, 6).alias("annual"), F.round(F.stddev_pop("r") * F.sqrt(F.lit(252.0)), 6).alias("vol"), F.round(x * F.sqrt(F.lit(252.0)), 6).alias("sharpe"), F.round(F.sqrt((1 + 0.5 * x * x) / F.count("*")) * F.sqrt(F.lit(252.0)), 6).alias("sharpe_se"))


@register("annualized_sharpe", f"WITH {base.DB} SELECT asset, round(CASE WHEN count(r1) >= 30 AND stddev_samp(r1) > 0 THEN avg(r1) / stddev_samp(r1) * sqrt(365.0) END, 6) AS sharpe FROM db GROUP BY 1")
def annualized_sharpe(spark, sf_dir):
    return base.daily_basics(spark, sf_dir).groupBy("asset").agg(F.round(F.when((F.count("r1") >= 30) & (F.stddev_samp("r1") > 0), F.avg("r1") / F.stddev_samp("r1") * F.sqrt(F.lit(365.0))), 6).alias("sharpe"))


@register("extra_record_metrics", f"{_NAV} SELECT year(ts)::INT AS year, round(exp(sum(ln(1 + r))) - 1, 6) + 0.0 AS ret, round(avg((r > 0)::INT), 6) AS win_rate, round(max(r), 6) AS best, round(min(r), 6) AS worst, round(avg(r) / sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(365.0), 6) AS sortino, round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 6) AS t FROM k GROUP BY 1")
def extra_record_metrics(spark, sf_dir):
    down = F.sqrt(F.avg(F.pow(F.least(col("r"), F.lit(0.0)), 2)))
    return small(spark, sf_dir).groupBy(F.year("ts").alias("year")).agg((F.round(F.exp(F.sum(F.log1p("r"))) - 1, 6) + 0.0).alias("ret"), F.round(F.avg((col("r") > 0).cast("int")), 6).alias("win_rate"), F.round(F.max("r"), 6).alias("best"), F.round(F.min("r"), 6).alias("worst"), F.round(F.avg("r") / down * F.sqrt(F.lit(365.0)), 6).alias("sortino"), F.round(F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("*"))), 6).alias("t"))


@register("benchmark_compare", f"WITH {_SMALL} SELECT count(*) AS n, round(avg(r - b) * 252, 6) AS active, round(stddev_samp(r - b) * sqrt(252.0), 6) AS tracking, round(avg(r - b) / stddev_samp(r - b) * sqrt(252.0), 6) AS information_ratio, round(corr(r, b), 6) AS correlation, round(covar_pop(r, b) / var_pop(b), 6) AS beta FROM x WHERE b IS NOT NULL")
def benchmark_compare(spark, sf_dir):
    return S.benchmark_compare(small(spark, sf_dir), "r", "b", 252.0)


@register("active_tstat", f"WITH {_SMALL} SELECT round(avg(r - b) / (stddev_samp(r - b) / sqrt(count(*))), 6) AS t FROM x WHERE b IS NOT NULL")
def active_tstat(spark, sf_dir):
    a = col("r") - col("b")
    return small(spark, sf_dir).where("b is not null").agg(F.round(F.avg(a) / (F.stddev_samp(a) / F.sqrt(F.count("*"))), 6).alias("t"))


@register("alpha_beta_regression", f"WITH {_SMALL} SELECT round(regr_slope(r, b), 6) AS beta, round(regr_intercept(r, b), 8) AS alpha, round(regr_r2(r, b), 6) AS r2 FROM x WHERE b IS NOT NULL")
def alpha_beta_regression(spark, sf_dir):
    return small(spark, sf_dir).where("b is not null").agg(F.round(F.regr_slope("r", "b"), 6).alias("beta"), F.round(F.regr_intercept("r", "b"), 8).alias("alpha"), F.round(F.regr_r2("r", "b"), 6).alias("r2"))


@register("benchmark_period", f"WITH {base.DB} SELECT asset, ts, round(lead(close, 21) OVER (PARTITION BY asset ORDER BY ts) / close - 1, 6) + 0.0 AS ret_21 FROM db")
def benchmark_period(spark, sf_dir):
    return base.daily(spark, sf_dir).select("asset", "ts", (F.round(F.lead("close", 21).over(Window.partitionBy("asset").orderBy("ts")) / col("close") - 1, 6) + 0.0).alias("ret_21"))


@register("walk_forward_split", f"WITH {_SMALL}, k AS (SELECT *, (row_number() OVER (ORDER BY ts) - 1) * 6 // count(*) OVER () AS blk FROM x) SELECT blk::INT AS block, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(365.0), 6) AS sharpe FROM k GROUP BY 1")
def walk_forward_split(spark, sf_dir):
    k = S.blocks(small(spark, sf_dir), "ts", 6)
    return k.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(365.0)), 6).alias("sharpe"))


@register("plateau", f"WITH {base.MX}, s AS (SELECT ts, avg(price) > 38000 AS ok, row_number() OVER (ORDER BY ts) AS i FROM mx GROUP BY ts), g AS (SELECT *, i - row_number() OVER (PARTITION BY ok ORDER BY ts) AS island FROM s), r AS (SELECT island, count(*) AS width, min(ts) AS first, max(ts) AS last FROM g WHERE ok GROUP BY 1) SELECT width, first, last FROM r ORDER BY width DESC, first LIMIT 1")
def plateau(spark, sf_dir):
    s = base.monthly(spark, sf_dir).groupBy("ts").agg((F.avg("price") > 38_000).alias("ok"))
    return S.longest_run(s, "ts", "ok")


@register("sharpe_difference_noise", f"WITH {_SMALL} SELECT round(sqrt((1 + 0.5 * pow(avg(r) / stddev_samp(r), 2)) / count(*)), 8) AS se, round(sqrt((2 - 2 * corr(r, b)) / count(*)), 8) AS se_difference FROM x WHERE b IS NOT NULL")
def sharpe_difference_noise(spark, sf_dir):
    return small(spark, sf_dir).where("b is not null").agg(F.round(F.sqrt((1 + 0.5 * F.pow(F.avg("r") / F.stddev_samp("r"), 2)) / F.count("*")), 8).alias("se"), F.round(F.sqrt((2 - 2 * F.corr("r", "b")) / F.count("*")), 8).alias("se_difference"))


_DRAWN = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@register("block_bootstrap", f"""WITH {_SMALL}, y AS (SELECT r, b, row_number() OVER (ORDER BY ts) - 1 AS i FROM x WHERE b IS NOT NULL), n AS (SELECT count(*) AS n FROM y),
  k AS (SELECT it, unnest(range(0, ((n + 19) // 20)::BIGINT)) AS k, n FROM n, range(200) t(it)),
  z AS (SELECT it, k, n, {_DRAWN.format("'17:' || it || ':' || k")} % n AS start FROM k),
  e AS (SELECT it, (start + j) % n AS i FROM z, range(20) t(j) WHERE k * 20 + j < n),
  p AS (SELECT avg(r) / stddev_samp(r) - avg(b) / stddev_samp(b) AS d FROM e JOIN y USING (i) GROUP BY it)
  SELECT count(*) AS iterations, round(quantile_cont(d, 0.05), 6) AS p05, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(avg((d > 0)::INT), 6) AS positive FROM p""")
def block_bootstrap(spark, sf_dir):
    return S.block_bootstrap(small(spark, sf_dir), "ts", "r", "b", iterations=200, block=20)


@register("permutation_null", f"""WITH {_SECTOR}, y AS (SELECT *, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM s),
  m AS (SELECT seed, ts, asset, r, fwd FROM y, range(-1, 20) t(seed) WHERE r IS NOT NULL AND fwd IS NOT NULL),
  a AS (SELECT seed, ts, r, row_number() OVER (PARTITION BY seed, ts ORDER BY asset) AS p FROM m),
  b AS (SELECT seed, ts, fwd, row_number() OVER (PARTITION BY seed, ts ORDER BY CASE WHEN seed < 0 THEN 0 ELSE {_DRAWN.format("seed || ':' || asset")} END, asset) AS p FROM m),
  j AS (SELECT * FROM a JOIN b USING (seed, ts, p)),
  k AS (SELECT seed, ts, {_avg_rank('r', 'seed, ts')} AS x, {_avg_rank('fwd', 'seed, ts')} AS y FROM j),
  i AS (SELECT seed, corr(x, y) AS ic FROM k GROUP BY seed, ts HAVING count(*) >= 10)
  SELECT seed::INT AS seed, count(ic) AS dates, round(avg(ic), 6) + 0.0 AS mean_ic FROM i GROUP BY 1""")
def permutation_null(spark, sf_dir):
    y = sectors(spark, sf_dir).withColumn("fwd", F.lead("r").over(Window.partitionBy("asset").orderBy("ts"))).where("r is not null and fwd is not null")
    return S.permutation_null(y, "ts", "asset", "r", "fwd", 20)


@register("effective_sample", f"{_IC} SELECT count(ic) AS n, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) + 0.0 AS naive_t, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic) / 5.0), 6) + 0.0 AS deflated_t FROM i")
def effective_sample(spark, sf_dir):
    x = F.avg("ic") / F.stddev_samp("ic")
    return ic_rows(spark, sf_dir).agg(F.count("ic").alias("n"), (F.round(x * F.sqrt(F.count("ic")), 6) + 0.0).alias("naive_t"), (F.round(x * F.sqrt(F.count("ic") / 5.0), 6) + 0.0).alias("deflated_t"))


@register("phase_combine", f"WITH {base.DB}, c AS (SELECT ts FROM db GROUP BY 1 HAVING count(*) = 5), k AS (SELECT d.asset, d.ts, d.close / first(d.close) OVER (PARTITION BY d.asset ORDER BY d.ts) AS nav FROM db d JOIN c USING (ts)) SELECT ts, round(avg(nav), 6) AS nav FROM k GROUP BY 1")
def phase_combine(spark, sf_dir):
    return S.phase_combine(base.daily(spark, sf_dir), "asset", "ts", "close", 5)


@register("fold_stitch", f"WITH {_SMALL} SELECT year(ts)::INT AS fold, ts, round(exp(sum(ln(1 + r)) OVER (ORDER BY ts)), 6) AS nav FROM x")
def fold_stitch(spark, sf_dir):
    return small(spark, sf_dir).select(F.year("ts").alias("fold"), "ts", F.round(F.exp(F.sum(F.log1p("r")).over(Window.orderBy("ts"))), 6).alias("nav"))


@register("gate_criteria", f"{_NAV}, m AS (SELECT avg(r) AS a, stddev_samp(r) AS s, avg(b) AS ab, stddev_samp(b) AS sb, count(*) AS n FROM k) SELECT 'positive' AS criterion, a > 0 AS passed FROM m UNION ALL SELECT 'survives_slippage', a - 0.0002 > 0 FROM m UNION ALL SELECT 'beats_baseline', a / s * sqrt(365.0) > ab / sb * sqrt(365.0) + 0.4 FROM m UNION ALL SELECT 'sample', n >= 60 FROM m")
def gate_criteria(spark, sf_dir):
    m = small(spark, sf_dir).agg(F.avg("r").alias("a"), F.stddev_samp("r").alias("s"), F.avg("b").alias("ab"), F.stddev_samp("b").alias("sb"), F.count("*").alias("n"))
    tests = {"positive": "a > 0", "survives_slippage": "a - 0.0002 > 0", "beats_baseline": "a / s * sqrt(365D) > ab / sb * sqrt(365D) + 0.4", "sample": "n >= 60"}
    return m.select(F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.expr(v).alias("passed")) for k, v in tests.items()))).alias("t")).select("t.*")


@register("gate_summary_minute", f"WITH {base.HB} SELECT month(ts)::INT AS fold, count(*) FILTER (abs(r1) > 1) AS trades, round(quantile_cont(abs(r1), 0.9), 6) AS p90, round(sum(quote_volume) / count(DISTINCT ts::DATE) * 30, 4) AS volume_30d FROM hb GROUP BY 1")
def gate_summary_minute(spark, sf_dir):
    return base.hourly_basics(spark, sf_dir).groupBy(F.month("ts").alias("fold")).agg(F.count_if(F.abs("r1") > 1).alias("trades"), F.round(F.percentile(F.abs("r1"), 0.9), 6).alias("p90"), F.round(F.sum("quote_volume") / F.countDistinct(col("ts").cast("date")) * 30, 4).alias("volume_30d"))


@register("spread_estimators", f"""WITH {base.HB0}, p AS (SELECT asset, ts, ln(high) AS h, ln(low) AS l, ln(close) AS c FROM hb0 WHERE high > 0 AND low > 0 AND close > 0),
  n AS (SELECT *, lead(h) OVER w AS h1, lead(l) OVER w AS l1, lead(ts) OVER w AS ts1 FROM p WINDOW w AS (PARTITION BY asset ORDER BY ts)),
  k AS (SELECT asset, (c - (h + l) / 2) * (c - (h1 + l1) / 2) AS v, pow(h - l, 2) + pow(h1 - l1, 2) AS beta, pow(greatest(h, h1) - least(l, l1), 2) AS gamma FROM n WHERE ts1 = ts + INTERVAL 1 HOUR),
  a AS (SELECT *, exp((sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2)))) AS e FROM k),
  s AS (SELECT *, 2 * (e - 1) / (1 + e) AS s FROM a),
  g AS (SELECT asset, count(*) AS pairs, count(*) FILTER (isfinite(v)) AS finite, avg(v) FILTER (isfinite(v)) AS v, avg(beta) AS beta, avg(gamma) AS gamma, count(*) FILTER (abs(s) < 0.5) AS inside, avg(greatest(s, 0)) FILTER (abs(s) < 0.5) AS s FROM s GROUP BY 1)
  SELECT asset, pairs, round(CASE WHEN finite >= 200 THEN 2 * sqrt(greatest(v, 0)) END, 6) + 0.0 AS abdi_ranaldo, round(beta, 6) AS beta, round(gamma, 6) AS gamma, inside, round(CASE WHEN inside >= 200 THEN s END, 6) + 0.0 AS corwin_schultz FROM g""")
def spread_estimators(spark, sf_dir):
    """Both of consecutive hours; values that spread over decades within an hour leave few of Corwin and Schultz's estimates inside the bound."""
    x = A.range_spreads(base.hourly(spark, sf_dir), "asset", "ts", 3600)
    return x.select("asset", "pairs", (F.round("abdi_ranaldo", 6) + 0.0).alias("abdi_ranaldo"), F.round("beta", 6).alias("beta"), F.round("gamma", 6).alias("gamma"), "inside", (F.round("corwin_schultz", 6) + 0.0).alias("corwin_schultz"))


@register("time_weighted_spread", "WITH k AS (SELECT event_type, value, epoch_us(lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) - epoch_us(ts) AS w FROM events) SELECT event_type, round(sum(value * w) / sum(w), 6) AS spread FROM k WHERE w IS NOT NULL GROUP BY 1")
def time_weighted_spread(spark, sf_dir):
    us = F.unix_micros(col("ts").cast("timestamp"))
    k = table(spark, sf_dir, "events").withColumn("w", F.lead(us).over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - us).where("w is not null")
    return k.groupBy("event_type").agg(F.round(F.sum(col("value") * col("w")) / F.sum("w"), 6).alias("spread"))


@register("direction_evaluation", f"WITH {_SMALL} SELECT CASE WHEN b > 0.0005 THEN 'up' WHEN b < -0.0005 THEN 'down' ELSE 'flat' END AS regime, count(*) AS n, round(avg((sign(r) = sign(b))::INT), 6) AS accuracy, round(corr(r, b), 6) AS correlation FROM x WHERE b IS NOT NULL GROUP BY 1")
def direction_evaluation(spark, sf_dir):
    regime = F.when(col("b") > 0.0005, "up").when(col("b") < -0.0005, "down").otherwise("flat")
    return small(spark, sf_dir).where("b is not null").groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg((F.signum("r") == F.signum("b")).cast("int")), 6).alias("accuracy"), F.round(F.corr("r", "b"), 6).alias("correlation"))


@register("attribution", f"WITH {_SMALL} SELECT round(avg(b) * 252, 6) AS core, round(avg(r - b) * 252, 6) AS overlay, round(avg(r - b) / (stddev_samp(r - b) / sqrt(count(*))), 6) AS overlay_t FROM x WHERE b IS NOT NULL")
def attribution(spark, sf_dir):
    a = col("r") - col("b")
    return small(spark, sf_dir).where("b is not null").agg(F.round(F.avg("b") * 252, 6).alias("core"), F.round(F.avg(a) * 252, 6).alias("overlay"), F.round(F.avg(a) / (F.stddev_samp(a) / F.sqrt(F.count("*"))), 6).alias("overlay_t"))


@register("live_stats", f"WITH {base.DB} SELECT asset, date_diff('day', min(ts), max(ts))::INT AS days, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) + 0.0 AS ret, round(CASE WHEN count(r1) >= 30 THEN avg(r1) / stddev_samp(r1) * sqrt(365.0) END, 6) AS sharpe FROM db GROUP BY 1")
def live_stats(spark, sf_dir):
    return base.daily_basics(spark, sf_dir).groupBy("asset").agg(F.date_diff(F.max("ts"), F.min("ts")).alias("days"), (F.round(F.max_by("close", "ts") / F.min_by("close", "ts") - 1, 6) + 0.0).alias("ret"), F.round(F.when(F.count("r1") >= 30, F.avg("r1") / F.stddev_samp("r1") * F.sqrt(F.lit(365.0))), 6).alias("sharpe"))


# ---------------------------------------------------------------- costs, weights, profit


@register("round_trip_cost", "WITH d AS (SELECT user_id, ts::DATE AS day, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.75) END AS c FROM events WHERE event_type = 'click' GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), m AS (SELECT q.user_id, q.day, max({'d': p.day, 'c': p.c}) AS b FROM q JOIN d p ON p.user_id = q.user_id AND p.day < q.day AND p.day >= q.day - 14 AND p.c IS NOT NULL GROUP BY 1, 2) SELECT q.user_id, q.day, round(9 + CASE WHEN d.day IS NOT NULL THEN d.c ELSE m.b.c END, 6) AS cost_bps FROM q LEFT JOIN d USING (user_id, day) LEFT JOIN m ON m.user_id = q.user_id AND m.day = q.day")
def round_trip_cost(spark, sf_dir):
    """Cost of the day; where the day is absent, of the last priced day within 14 days; a day without price has none."""
    from ..operators.joins import asof_join

    e = table(spark, sf_dir, "events").withColumn("day", col("ts").cast("date"))
    d = e.where("event_type = 'click'").groupBy("user_id", "day").agg(F.when(F.count("*") >= 2, F.percentile("value", 0.75)).alias("c"))
    q = e.where("event_type = 'purchase'").select("user_id", "day").distinct().join(d.withColumn("have", F.lit(True)), ["user_id", "day"], "left")
    us = F.unix_date("day").cast("long") * 86_400_000_000
    out = asof_join(q, d.where("c is not null").select("user_id", "day", col("c").alias("p")), ["user_id"], us, us, "past", ["p"], tolerance_s=14 * 86_400)
    return out.select("user_id", "day", F.round(9 + F.when(col("have"), col("c")).otherwise(col("past.p")), 6).alias("cost_bps"))


@register("flat_round_trip", "SELECT p_partkey, round(2 * (4.5 + coalesce(CASE WHEN p_size > 5 THEN p_size / 10.0 END, 0.5) / 2 + 1), 6) AS bps FROM part")
def flat_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(2 * (4.5 + F.coalesce(F.when(col("p_size") > 5, col("p_size") / 10.0), F.lit(0.5)) / 2 + 1), 6).alias("bps"))


_IMPACT = "CASE WHEN qty > 0 THEN 0.1 * sqrt(1000 / (qty * price)) * disc * 1e4 ELSE 10000 END"


@register("impact_estimate", f"WITH {base.MX} SELECT asset, ts, round({_IMPACT}, 6) AS impact_bps, round({_IMPACT} + 0.5 + 4.5, 6) AS total_bps FROM mx")
def impact_estimate(spark, sf_dir):
    i = S.sqrt_impact(F.lit(1000.0), col("qty") * col("price"), col("disc"), 0.1)
    return base.monthly(spark, sf_dir).select("asset", "ts", F.round(i, 6).alias("impact_bps"), F.round(i + 5.0, 6).alias("total_bps"))


@register("execution_cost", f"WITH {base.MX} SELECT asset, ts, round((2.5 + 5 * coalesce(CASE WHEN n > 2 THEN tax * 100 END, 20) + {_IMPACT}) * 1.5 + CASE WHEN asset % 3 = 0 THEN 5 ELSE 0 END, 6) AS bps, round(disc * 21 / 252 * 1e4, 6) AS borrow_bps FROM mx")
def execution_cost(spark, sf_dir):
    i = S.sqrt_impact(F.lit(1000.0), col("qty") * col("price"), col("disc"), 0.1)
    cost = (2.5 + 5 * F.coalesce(F.when(col("n") > 2, col("tax") * 100), F.lit(20.0)) + i) * 1.5 + F.when(col("asset") % 3 == 0, 5).otherwise(0)
    return base.monthly(spark, sf_dir).select("asset", "ts", F.round(cost, 6).alias("bps"), F.round(col("disc") * 21 / 252 * 1e4, 6).alias("borrow_bps"))


@register("net_edge_side", f"WITH {_SECTOR} SELECT asset, ts, CASE WHEN greatest(r, -r) - tax - 0.01 > 0 THEN CASE WHEN r > 0 THEN 'long' ELSE 'short' END END AS side, round(greatest(abs(r) - tax - 0.01, 0), 6) AS edge FROM s WHERE r IS NOT NULL")
def net_edge_side(spark, sf_dir):
    edge = F.abs("r") - col("tax") - 0.01
    return sectors(spark, sf_dir).where("r is not null").select("asset", "ts", F.when(edge > 0, F.when(col("r") > 0, "long").otherwise("short")).alias("side"), F.round(F.greatest(edge, F.lit(0.0)), 6).alias("edge"))


_W = f"{_SECTOR}, v AS (SELECT asset, ts, sector, r, qty, price, 1 / (0.01 + disc) AS iv FROM s WHERE r IS NOT NULL)"


def weights(spark, sf_dir):
    return sectors(spark, sf_dir).where("r is not null").select("asset", "ts", "sector", "r", "qty", "price", (1 / (0.01 + col("disc"))).alias("iv"))


@register("size_weights", f"WITH {_W} SELECT asset, ts, round(least(0.25, 0.8 / count(*) OVER g), 6) AS equal_w, round(least(0.25, 0.8 * iv / sum(iv) OVER g), 6) AS inverse_vol_w, round(sign(r) * least(0.25, 0.4 * abs(r) * iv / sum(abs(r) * iv) OVER (PARTITION BY ts, sign(r))), 6) + 0.0 AS risk_adjusted_w FROM v WINDOW g AS (PARTITION BY ts)")
def size_weights(spark, sf_dir):
    g = Window.partitionBy("ts")
    v = weights(spark, sf_dir)
    score = F.abs("r") * col("iv")
    return v.select("asset", "ts", F.round(F.least(F.lit(0.25), 0.8 / F.count("*").over(g)), 6).alias("equal_w"), F.round(F.least(F.lit(0.25), 0.8 * col("iv") / F.sum("iv").over(g)), 6).alias("inverse_vol_w"), (F.round(F.signum("r") * F.least(F.lit(0.25), 0.4 * score / F.sum(score).over(Window.partitionBy("ts", F.signum("r")))), 6) + 0.0).alias("risk_adjusted_w"))


@register("size_anchored", f"WITH {_W} SELECT asset, ts, round(0.02 * abs(r) / 0.3 * (0.05 * iv), 6) AS w FROM v")
def size_anchored(spark, sf_dir):
    return weights(spark, sf_dir).select("asset", "ts", F.round(0.02 * F.abs("r") / 0.3 * (0.05 * col("iv")), 6).alias("w"))


@register("side_budget", f"WITH {_W} SELECT ts, round((count(*) / 100.0 + avg(r)) / 2, 6) + 0.0 AS long, round((count(*) / 100.0 - avg(r)) / 2, 6) + 0.0 AS short FROM v GROUP BY 1")
def side_budget(spark, sf_dir):
    g, n = F.count("*") / 100.0, F.avg("r")
    return weights(spark, sf_dir).groupBy("ts").agg((F.round((g + n) / 2, 6) + 0.0).alias("long"), (F.round((g - n) / 2, 6) + 0.0).alias("short"))


_ALLOC = "a AS (SELECT *, sign(r) * least(0.05, abs(r) / 5) AS w FROM v), b AS (SELECT *, w * least(1, 0.5 / sum(abs(w)) OVER (PARTITION BY ts, sign(r))) AS w2 FROM a), c AS (SELECT *, w2 * least(1, 0.8 / sum(abs(w2)) OVER (PARTITION BY ts)) AS w3 FROM b WHERE w <> 0)"


@register("allocate_budget", f"WITH {_W}, {_ALLOC} SELECT asset, ts, round(w3, 6) + 0.0 AS w FROM c WHERE abs(w3) >= 0.001")
def allocate_budget(spark, sf_dir):
    return S.allocate(weights(spark, sf_dir), "ts", F.signum("r") * F.least(F.lit(0.05), F.abs("r") / 5), 0.5, 0.8, 0.001).select("asset", "ts", (F.round("w", 6) + 0.0).alias("w"))


@register("group_cap", f"WITH {_W}, {_ALLOC}, d AS (SELECT *, w3 * least(1, 0.15 / sum(abs(w3)) OVER (PARTITION BY ts, sector)) AS w4 FROM c WHERE abs(w3) >= 0.001) SELECT asset, ts, round(w4, 6) + 0.0 AS w FROM d WHERE abs(w4) >= 0.001")
def group_cap(spark, sf_dir):
    a = S.allocate(weights(spark, sf_dir), "ts", F.signum("r") * F.least(F.lit(0.05), F.abs("r") / 5), 0.5, 0.8, 0.001)
    d = a.withColumn("w", col("w") * F.least(F.lit(1.0), 0.15 / F.sum(F.abs("w")).over(Window.partitionBy("ts", "sector"))))
    return d.where("abs(w) >= 0.001").select("asset", "ts", (F.round("w", 6) + 0.0).alias("w"))


@register("risk_checks", f"WITH {_W}, {_ALLOC}, g AS (SELECT ts, sum(abs(w3)) AS gross, abs(sum(w3)) AS net, max(abs(w3)) AS largest, count(*) AS n FROM c GROUP BY 1) SELECT ts, 'gross' AS check_name, gross <= 0.7 AS passed FROM g UNION ALL SELECT ts, 'net', net <= 0.2 FROM g UNION ALL SELECT ts, 'position', largest <= 0.04 FROM g UNION ALL SELECT ts, 'count', n <= 90 FROM g")
def risk_checks(spark, sf_dir):
    a = S.allocate(weights(spark, sf_dir), "ts", F.signum("r") * F.least(F.lit(0.05), F.abs("r") / 5), 0.5, 0.8, 0.0)
    g = a.groupBy("ts").agg(F.sum(F.abs("w")).alias("gross"), F.abs(F.sum("w")).alias("net"), F.max(F.abs("w")).alias("largest"), F.count("*").alias("n"))
    tests = {"gross": "gross <= 0.7", "net": "net <= 0.2", "position": "largest <= 0.04", "count": "n <= 90"}
    return g.select("ts", F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.expr(v).alias("passed")) for k, v in tests.items()))).alias("t")).select("ts", "t.*")


_DRIFT = f"WITH {_W}, p AS (SELECT asset, ts, r / 10 AS w, coalesce(lag(r) OVER (PARTITION BY asset ORDER BY ts) / 10, 0) AS held FROM v), d AS (SELECT *, w - held AS drift FROM p)"


def _drift(spark, sf_dir):
    p = weights(spark, sf_dir).select("asset", "ts", (col("r") / 10).alias("w"), F.coalesce(F.lag("r").over(Window.partitionBy("asset").orderBy("ts")) / 10, F.lit(0.0)).alias("held"))
    return p.withColumn("drift", col("w") - col("held"))


@register("turnover_deadband", f"{_DRIFT} SELECT asset, ts, round(drift, 6) + 0.0 AS trade FROM d WHERE abs(drift) >= 0.02 OR (w * held < 0)")
def turnover_deadband(spark, sf_dir):
    return _drift(spark, sf_dir).where("abs(drift) >= 0.02 or w * held < 0").select("asset", "ts", (F.round("drift", 6) + 0.0).alias("trade"))


@register("order_rank", f"{_DRIFT}, k AS (SELECT *, CASE WHEN w * held < 0 THEN 0 WHEN abs(w) < abs(held) THEN 1 WHEN held <> 0 THEN 2 ELSE 3 END AS kind FROM d) SELECT asset, ts, kind::INT AS kind, row_number() OVER (PARTITION BY ts ORDER BY kind, asset)::INT AS place FROM k")
def order_rank(spark, sf_dir):
    k = _drift(spark, sf_dir).withColumn("kind", F.when(col("w") * col("held") < 0, 0).when(F.abs("w") < F.abs("held"), 1).when(col("held") != 0, 2).otherwise(3))
    return k.select("asset", "ts", "kind", X.place(["ts"], col("kind"), col("asset")).alias("place"))


@register("turnover", f"{_DRIFT} SELECT ts, round(sum(abs(drift)), 6) AS turnover FROM d GROUP BY 1")
def turnover(spark, sf_dir):
    return _drift(spark, sf_dir).groupBy("ts").agg(F.round(F.sum(F.abs("drift")), 6).alias("turnover"))


@register("book_pnl", f"{_DRIFT} SELECT ts, round(sum(held * w * 10) - sum(abs(drift)) * 0.001, 6) + 0.0 AS pnl FROM d GROUP BY 1")
def book_pnl(spark, sf_dir):
    return _drift(spark, sf_dir).groupBy("ts").agg((F.round(F.sum(col("held") * col("w") * 10) - F.sum(F.abs("drift")) * 0.001, 6) + 0.0).alias("pnl"))


@register("daily_marks", f"WITH {base.DB}, e AS (SELECT asset, date_trunc('month', ts)::TIMESTAMP AS m, arg_min(close, ts) AS entry FROM db GROUP BY 1, 2) SELECT d.ts, round(avg(d.close / e.entry) - 0.0005, 6) AS nav FROM db d JOIN e ON d.asset = e.asset AND date_trunc('month', d.ts) = e.m GROUP BY 1")
def daily_marks(spark, sf_dir):
    """Held weights marked each session against their entry in the month."""
    d = base.daily(spark, sf_dir).withColumn("m", F.date_trunc("month", "ts"))
    e = d.groupBy("asset", "m").agg(F.min_by("close", "ts").alias("entry"))
    return d.join(e, ["asset", "m"]).groupBy("ts").agg(F.round(F.avg(col("close") / col("entry")) - 0.0005, 6).alias("nav"))


@register("regime_tilt", f"WITH {base.DB} SELECT asset, ts, round(CASE WHEN close > avg(close) OVER w20 * 1.1 THEN 0.25 WHEN close < avg(close) OVER w20 * 0.9 THEN -0.25 ELSE 0 END, 6) + 0.0 AS tilt, round(greatest(-0.5, least(0.5, (avg(close) OVER w20 / avg(close) OVER w60 - 1) * 8)), 6) + 0.0 AS slope_tilt FROM db {base.WINDOWS}")
def regime_tilt(spark, sf_dir):
    w = lambda n: Window.partitionBy("asset").orderBy("ts").rowsBetween(-(n - 1), 0)
    m = F.avg("close").over(w(20))
    return base.daily(spark, sf_dir).select("asset", "ts", (F.when(col("close") > m * 1.1, 0.25).when(col("close") < m * 0.9, -0.25).otherwise(0.0)).alias("tilt"), (F.round(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (m / F.avg("close").over(w(60)) - 1) * 8)), 6) + 0.0).alias("slope_tilt"))


@register("forecast_decompose", f"WITH {_W}, m AS (SELECT ts, avg(qty) / 1e4 AS f FROM v GROUP BY 1) SELECT asset, v.ts, round(r - avg(r) OVER (PARTITION BY v.ts) + f, 6) + 0.0 AS forecast FROM v JOIN m ON v.ts = m.ts")
def forecast_decompose(spark, sf_dir):
    v, w = weights(spark, sf_dir), Window.partitionBy("ts")
    return v.select("asset", "ts", (F.round(col("r") - F.avg("r").over(w) + F.avg("qty").over(w) / 1e4, 6) + 0.0).alias("forecast"))


@register("concentration_union", f"WITH {_W}, t AS (SELECT asset, ts, r / 10 AS w FROM v UNION ALL SELECT asset, ts + INTERVAL 1 MONTH, r / 10 FROM v) SELECT asset, ts, round(sum(w), 6) + 0.0 AS w FROM t GROUP BY 1, 2")
def concentration_union(spark, sf_dir):
    v = weights(spark, sf_dir).select("asset", "ts", (col("r") / 10).alias("w"))
    late = v.select("asset", ntz(F.expr("ts + INTERVAL 1 MONTH")).alias("ts"), "w")
    return v.union(late).groupBy("asset", "ts").agg((F.round(F.sum("w"), 6) + 0.0).alias("w"))


@register("breakout_signal", f"WITH {base.HB} SELECT asset, ts, CASE WHEN close > open * 1.2 THEN 1 ELSE -1 END AS side FROM hb WHERE (close > open * 1.2 OR close < open * 0.8) AND hour(ts) BETWEEN 10 AND 15")
def breakout_signal(spark, sf_dir):
    b = base.hourly(spark, sf_dir).where((F.hour("ts").between(10, 15)) & ((col("close") > col("open") * 1.2) | (col("close") < col("open") * 0.8)))
    return b.select("asset", "ts", F.when(col("close") > col("open") * 1.2, 1).otherwise(-1).alias("side"))


@register("beta_90", f"WITH {base.DB}, b AS (SELECT ts, lr AS m FROM db WHERE asset = 'P1'), j AS (SELECT d.asset, d.ts, d.lr AS own, b.m FROM db d LEFT JOIN b USING (ts)), p AS (SELECT *, CASE WHEN own IS NOT NULL AND m IS NOT NULL THEN own END AS y, CASE WHEN own IS NOT NULL AND m IS NOT NULL THEN m END AS x FROM j) SELECT asset, ts, round(CASE WHEN count(x) OVER w90 >= 80 AND var_pop(x) OVER w90 > 1e-18 THEN covar_pop(y, x) OVER w90 / var_pop(x) OVER w90 END, 6) + 0.0 AS beta FROM p WINDOW w90 AS (PARTITION BY asset ORDER BY ts ROWS 89 PRECEDING)")
def beta_90(spark, sf_dir):
    from ..operators.windows import Trailing

    d = base.daily_basics(spark, sf_dir)
    j = d.select("asset", "ts", "lr").join(d.where("asset = 'P1'").select("ts", col("lr").alias("m")), "ts", "left")
    return j.select("asset", "ts", (F.round(Trailing("asset").beta(90, "lr", "m", 80), 6) + 0.0).alias("beta"))


@register("residual_return", f"WITH {_SECTOR}, m AS (SELECT ts, avg(r) AS market FROM s GROUP BY 1) SELECT asset, s.ts, round(r - 0.9 * market, 6) + 0.0 AS resid, round(r - avg(r) OVER (PARTITION BY s.ts, sector), 6) + 0.0 AS sector_rel FROM s JOIN m ON s.ts = m.ts")
def residual_return(spark, sf_dir):
    return sectors(spark, sf_dir).select("asset", "ts", (F.round(col("r") - 0.9 * F.avg("r").over(Window.partitionBy("ts")), 6) + 0.0).alias("resid"), (F.round(col("r") - F.avg("r").over(Window.partitionBy("ts", "sector")), 6) + 0.0).alias("sector_rel"))


@register("idio_vol_60", f"WITH {base.DB}, m AS (SELECT ts, avg(r1) AS f FROM db GROUP BY 1), g AS (SELECT ts, avg(r1) AS h FROM db WHERE asset IN ('P1', 'P2') GROUP BY 1), j AS (SELECT asset, ts, r1 AS y, f AS a, h - f AS b FROM db JOIN m USING (ts) LEFT JOIN g USING (ts)), p AS (SELECT asset, ts, count(*) FILTER (y IS NOT NULL AND b IS NOT NULL) OVER w AS n, var_pop(y) OVER w AS yy, var_pop(a) OVER w AS aa, var_pop(b) OVER w AS bb, covar_pop(a, b) OVER w AS ab, covar_pop(y, a) OVER w AS ya, covar_pop(y, b) OVER w AS yb FROM (SELECT * FROM j WHERE y IS NOT NULL AND b IS NOT NULL) WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 59 PRECEDING)) SELECT asset, ts, round(CASE WHEN n = 60 AND aa * bb - ab * ab > 1e-12 THEN sqrt(greatest(yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab), 0)) END, 4) AS idio FROM p")
def idio_vol_60(spark, sf_dir):
    return S.two_factor_residual(base.daily_basics(spark, sf_dir), 60)


@register("autocorr_lag1", f"WITH {base.HB}, k AS (SELECT asset, r1, lag(r1) OVER (PARTITION BY asset ORDER BY ts) AS p FROM hb) SELECT asset, round(corr(r1, p), 6) + 0.0 AS autocorr FROM k GROUP BY 1")
def autocorr_lag1(spark, sf_dir):
    k = base.hourly_basics(spark, sf_dir).withColumn("p", F.lag("r1").over(Window.partitionBy("asset").orderBy("ts")))
    return k.groupBy("asset").agg((F.round(F.corr("r1", "p"), 6) + 0.0).alias("autocorr"))


@register("sequence_tensor", f"WITH {base.HB}, z AS (SELECT asset, ts, greatest(-5.0, least(5.0, CASE WHEN stddev_samp(close) OVER g > 0 THEN (close - avg(close) OVER g) / stddev_samp(close) OVER g END)) AS z FROM hb WINDOW g AS (PARTITION BY ts)) SELECT asset, ts, len(list(z) OVER w)::INT AS steps, round(list_sum(list(z) OVER w), 4) + 0.0 AS total FROM z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 23 PRECEDING) QUALIFY len(list(z) OVER w) = 24")
def sequence_tensor(spark, sf_dir):
    z = base.hourly(spark, sf_dir).select("asset", "ts", X.zscore("close", ["ts"], 5.0).alias("z")).where("z is not null")
    s = z.select("asset", "ts", F.collect_list("z").over(Window.partitionBy("asset").orderBy("ts").rowsBetween(-23, 0)).alias("tensor")).where(F.size("tensor") == 24)
    return s.select("asset", "ts", F.size("tensor").alias("steps"), (F.round(F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))
