"""Further queries: remaining sources as column jobs, composed matrices, market-wide features, resumption."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import cross_section as X
from ..operators.joins import forward_exact
from ..operators.windows import Trailing
from ..registry import register
from ..sources import readers as R
from ..sources.staging import shared_path
from ..streaming import streams as ST
from . import base
from .base import table
from .q_cross import _LBL, _norm, labels

col = F.col


def _r(c):
    return F.round(c, 6) + 0.0


@register("logret_k", f"WITH {base.HB} SELECT asset, ts, " + ", ".join(f"round(ln(close / lag(close, {k}) OVER (PARTITION BY asset ORDER BY ts)), 6) + 0.0 AS ret_{k}" for k in (1, 3, 5, 15, 30, 60)) + " FROM hb")
def logret_k(spark, sf_dir):
    t = Trailing("asset")
    return base.hourly(spark, sf_dir).select("asset", "ts", *(_r(t.logret(k)).alias(f"ret_{k}") for k in (1, 3, 5, 15, 30, 60)))


@register("finite_or_null", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio FROM lineitem")
def finite_or_null(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = F.when(col("l_tax") == 0, F.lit(float("inf"))).otherwise(col("l_discount") / col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.finite_or_null(raw), 6).alias("ratio"))


@register("lot_grid_check", "SELECT o_orderkey, (o_totalprice * 100)::BIGINT % 5 = 0 AS on_price_grid, o_custkey % 10 = 0 AS on_qty_grid FROM orders")
def lot_grid_check(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.on_grid("o_totalprice", "0.05").alias("on_price_grid"), S.on_grid("o_custkey", "10").alias("on_qty_grid"))


@register("validate_selection", f"WITH {base.MX} SELECT asset, ts, round(qty, 6) AS qty, round(disc, 6) AS disc FROM mx")
def validate_selection(spark, sf_dir):
    m = base.monthly(spark, sf_dir)
    return m.select("asset", "ts", *(F.round(x, 6).alias(x) for x in B.validate_selection(m, ["qty", "disc"])))


@register("read_agg_trades", "SELECT event_type, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n, round(sum(value), 6) AS notional FROM events WHERE value > 0 GROUP BY 1, 2")
def read_agg_trades(spark, sf_dir):
    """A tape written as text lines and read back to minute sums; lines that are no trade are left out."""
    e = table(spark, sf_dir, "events")
    line = e.select(F.concat_ws(",", F.unix_millis(col("ts").cast("timestamp")).cast("string"), "event_type", col("value").cast("string")).alias("line"))
    parts = F.split("line", ",")
    rows = line.where(col("line").rlike("^[0-9]+,")).select(S.epoch_timestamp(parts[0].cast("long")).alias("t"), parts[1].alias("event_type"), parts[2].cast("double").alias("value")).where("value > 0")
    return rows.groupBy("event_type", base.ntz(F.date_trunc("minute", "t")).alias("minute")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("notional"))


@register("read_symbol_list", "SELECT s_suppkey, s_name AS code FROM supplier WHERE s_nationkey % 2 = 0")
def read_symbol_list(spark, sf_dir):
    """Vendor documents parsed by a strict schema; only common stock stays."""
    j = F.to_json(F.struct(col("s_suppkey").alias("id"), col("s_name").alias("Code"), F.when(col("s_nationkey") % 2 == 0, "Common Stock").otherwise("ETF").alias("Type")))
    r = table(spark, sf_dir, "supplier").select(F.from_json(j, "id long, Code string, Type string").alias("r"))
    return r.where("r.Type = 'Common Stock'").select(col("r.id").alias("s_suppkey"), col("r.Code").alias("code"))


@register("read_pdmr", """SELECT o_orderdate::DATE + 1 AS publication_date, '08:' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':00' AS publication_time, 'Issuer; "' || (o_custkey % 50) || '" Öst' AS issuer, 'LEI' || o_custkey AS lei, 'Notifier ' || o_custkey AS notifier, 'Person ' || o_custkey AS pdmr, 'CEO' AS position,
    o_orderkey % 3 = 0 AS closely_associated, o_orderkey % 4 = 0 AS amendment, CASE WHEN o_orderkey % 4 = 0 THEN 'Row one' || chr(10) || 'row two; corrected' END AS amendment_details, o_orderkey % 2 = 0 AS initial_notification, false AS option_programme, CASE o_orderstatus WHEN 'F' THEN 'Disposal' ELSE 'Acquisition' END AS nature, 'Share' AS instrument_type,
    'Share ' || o_orderkey AS instrument_name, CASE WHEN o_orderkey % 5 > 0 THEN 'SE0000108656' END AS isin, o_orderdate::DATE AS transaction_date, (o_orderkey * 1000)::DOUBLE AS volume, 'Quantity' AS unit, CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice, 2) END AS price, 'SEK' AS currency, '' AS venue, 'Current' AS status FROM orders""")
def read_pdmr(spark, sf_dir):
    """Every order as an insider report, written as UTF-16LE files and read back: quotes, line ends and semicolons inside values, spaced thousands, decimal commas, blanks."""
    k, cust = col("o_orderkey"), col("o_custkey").cast("string")
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    text = {
        "publication": F.concat(day(F.date_add("o_orderdate", 1)), F.lit(" 08:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00")), "issuer": F.concat(F.lit('Issuer; "'), (col("o_custkey") % 50).cast("string"), F.lit('" Öst')), "lei": F.concat(F.lit("LEI"), cust),
        "notifier": F.concat(F.lit("Notifier "), cust), "pdmr": F.concat(F.lit("Person "), cust), "position": F.lit("CEO"), "closely_associated": F.when(k % 3 == 0, "Yes").otherwise(""), "amendment": F.when(k % 4 == 0, "Ja").otherwise("No"),
        "amendment_details": F.when(k % 4 == 0, "Row one\nrow two; corrected"), "initial_notification": F.when(k % 2 == 0, "yes"), "option_programme": F.lit(""), "nature": F.when(col("o_orderstatus") == "F", "Disposal").otherwise("Acquisition"), "instrument_type": F.lit("Share"),
        "instrument_name": F.concat(F.lit("Share "), k.cast("string")), "isin": F.when(k % 5 > 0, "SE0000108656"), "transaction": F.concat(day("o_orderdate"), F.lit(" 00:00:00")), "volume": F.translate(F.format_number(k * 1000, 0), ",", "\u00a0"), "unit": F.lit("Quantity"),
        "price": F.when(col("o_orderpriority") != "5-LOW", F.translate(F.format_number("o_totalprice", 2), ",.", " ,")), "currency": F.lit("SEK"), "venue": F.lit(""), "status": F.lit("Current"),
    }
    path = shared_path(spark, "pdmr")
    R.write_pdmr(table(spark, sf_dir, "orders").select(*(x.alias(name) for name, x in text.items())), path)
    return R.read_pdmr(spark, path).withColumn("price", F.round("price", 2))


@register("read_macro", "SELECT o_orderpriority AS series, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def read_macro(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(col("o_orderpriority").alias("series"), col("o_orderdate").cast("date").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return B.require_unique(rows, ["series", "day"])


@register("read_history_archive", f"WITH {base.DB0} SELECT asset, ts::DATE AS day, close FROM db0 WHERE close > 0 AND high >= low")
def read_history_archive(spark, sf_dir):
    """Histories by instrument, held as one JSON document a month, exploded and validated; one row for each date."""
    d = base.daily(spark, sf_dir).where("close > 0 and high >= low")
    bar = F.struct(col("ts").cast("date").alias("day"), "close")
    docs = d.groupBy("asset", F.trunc("ts", "month").alias("month")).agg(F.to_json(F.collect_list(bar)).alias("j"))
    rows = docs.select("asset", F.explode(F.from_json("j", "array<struct<day: date, close: double>>")).alias("b")).select("asset", "b.*")
    return rows.groupBy("asset", "day").agg(F.min("close").alias("close"))


@register("read_xbrl_facts", "SELECT o_orderkey, 'ifrs-full:Revenue' AS concept, o_orderdate::DATE AS \"end\", 'SEK' AS unit, round(o_totalprice, 2) AS value FROM orders WHERE o_orderpriority <> '5-LOW'")
def read_xbrl_facts(spark, sf_dir):
    """Facts with four dimensions and an IFRS concept, from a JSON map of facts."""
    d = F.create_map(F.lit("concept"), F.when(col("o_orderpriority") == "5-LOW", "own:Other").otherwise("ifrs-full:Revenue"), F.lit("period"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("unit"), F.lit("SEK"), F.lit("entity"), F.lit("e"))
    facts = F.to_json(F.create_map(F.lit("f1"), F.struct(F.round("o_totalprice", 2).cast("string").alias("value"), d.alias("dimensions"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", col("o_orderdate").cast("date").alias("report_end"), facts.alias("j"))
    return R.xbrl_facts(rows, "j", "report_end").select("o_orderkey", "concept", "end", "unit", F.round(col("value").cast("double"), 2).alias("value"))


@register("quarterly_statements", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS period, round(o_totalprice, 2) AS income, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 3, 2) END AS balance FROM orders")
def quarterly_statements(spark, sf_dir):
    period = F.date_format("o_orderdate", "yyyy-MM-dd")
    cell = lambda v: F.create_map(period, F.struct(period.alias("filing_date"), F.round(v, 2).alias("amount")))
    doc = F.to_json(F.struct(cell(col("o_totalprice")).alias("income"), F.when(col("o_orderstatus") != "P", cell(col("o_totalprice") / 3)).alias("balance")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("j"))
    return R.statements(rows, "j", ["income", "balance"]).select("o_orderkey", "period", "income", "balance")


@register("beta_252_macro_beta", f"WITH {base.DB}, b AS (SELECT ts, lr AS m FROM db WHERE asset = 'P1'), j AS (SELECT d.asset, d.ts, d.lr AS own, b.m FROM db d LEFT JOIN b USING (ts)), p AS (SELECT *, CASE WHEN own IS NOT NULL AND m IS NOT NULL THEN own END AS y, CASE WHEN own IS NOT NULL AND m IS NOT NULL THEN m END AS x FROM j) SELECT asset, ts, round(CASE WHEN count(x) OVER w252 >= 200 AND var_pop(x) OVER w252 > 1e-18 THEN covar_pop(y, x) OVER w252 / var_pop(x) OVER w252 END, 6) + 0.0 AS beta_252, round(CASE WHEN count(x) OVER w126 >= 80 AND var_pop(x) OVER w126 > 1e-18 THEN covar_pop(y, x) OVER w126 / var_pop(x) OVER w126 END, 6) + 0.0 AS macro_beta_126 FROM p WINDOW w252 AS (PARTITION BY asset ORDER BY ts ROWS 251 PRECEDING), w126 AS (PARTITION BY asset ORDER BY ts ROWS 125 PRECEDING)")
def beta_252_macro_beta(spark, sf_dir):
    d, t = base.daily_basics(spark, sf_dir), Trailing("asset")
    j = d.select("asset", "ts", "lr").join(d.where("asset = 'P1'").select("ts", col("lr").alias("m")), "ts", "left")
    return j.select("asset", "ts", _r(t.beta(252, "lr", "m", 200)).alias("beta_252"), _r(t.beta(126, "lr", "m", 80)).alias("macro_beta_126"))


@register("macro_exposure", f"WITH {base.DB}, b AS (SELECT ts, lr AS m, close / lag(close, 21) OVER (ORDER BY ts) - 1 AS r21 FROM db WHERE asset = 'P1'), j AS (SELECT d.asset, d.ts, CASE WHEN b.m IS NOT NULL THEN d.lr END AS y, CASE WHEN d.lr IS NOT NULL THEN b.m END AS x, r21 FROM db d LEFT JOIN b USING (ts)) SELECT asset, ts, round(CASE WHEN count(x) OVER w >= 80 AND var_pop(x) OVER w > 1e-18 THEN covar_pop(y, x) OVER w / var_pop(x) OVER w * r21 END, 6) + 0.0 AS exposure_21 FROM j WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 125 PRECEDING)")
def macro_exposure(spark, sf_dir):
    d, t = base.daily_basics(spark, sf_dir), Trailing("asset")
    macro = d.where("asset = 'P1'").select("ts", col("lr").alias("m"), t.ret(21).alias("r21"))
    j = d.select("asset", "ts", "lr").join(macro, "ts", "left")
    return j.select("asset", "ts", _r(t.beta(126, "lr", "m", 80) * col("r21")).alias("exposure_21"))


_DIR = f"WITH {base.DB}, f AS (SELECT asset, ts, close / lag(close, 21) OVER o - 1 AS r21, close / lag(close, 63) OVER o - 1 AS r63 FROM db WINDOW o AS (PARTITION BY asset ORDER BY ts))"


@register("direction_features", f"{_DIR} SELECT ts, round(coalesce(max(r21) FILTER (asset = 'P1'), 0), 6) + 0.0 AS ret_21, (max(r21) FILTER (asset = 'P1') IS NULL)::INT AS ret_21_missing, round(coalesce(avg((r21 > 0)::INT) FILTER (asset <> 'P1'), 0), 6) AS breadth_21, round(coalesce(median(r63) FILTER (asset <> 'P1'), 0), 6) + 0.0 AS median_63, round(coalesce(stddev_pop(r21) FILTER (asset <> 'P1'), 0), 6) AS dispersion_21 FROM f GROUP BY 1")
def direction_features(spark, sf_dir):
    """One index beside the breadth, median and dispersion of the others; a value or 0, and a flag."""
    t = Trailing("asset")
    f = base.daily(spark, sf_dir).select("asset", "ts", t.ret(21).alias("r21"), t.ret(63).alias("r63"))
    own, rest = (lambda x: F.when(col("asset") == "P1", x)), (lambda x: F.when(col("asset") != "P1", x))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return f.groupBy("ts").agg(_r(zero(F.max(own(col("r21"))))).alias("ret_21"), F.max(own(col("r21"))).isNull().cast("int").alias("ret_21_missing"), F.round(zero(F.avg(rest((col("r21") > 0).cast("int")))), 6).alias("breadth_21"), _r(zero(F.percentile(rest(col("r63")), 0.5))).alias("median_63"), F.round(zero(F.stddev_pop(rest(col("r21")))), 6).alias("dispersion_21"))


@register("event_reaction", f"WITH {base.DB}, e AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS s FROM db), v AS (SELECT asset, ts, s FROM e WHERE s % 50 = 0) SELECT v.asset, v.ts, round(a.close / p.close - 1, 6) + 0.0 AS reaction_1, round(b.close / p.close - 1, 6) + 0.0 AS reaction_5 FROM v JOIN e p ON p.asset = v.asset AND p.s = v.s - 1 LEFT JOIN e a ON a.asset = v.asset AND a.s = v.s LEFT JOIN e b ON b.asset = v.asset AND b.s = v.s + 4")
def event_reaction(spark, sf_dir):
    """Price reaction 1 and 5 sessions after an event, from the close before it; every fiftieth session of an asset stands for an event."""
    t = Window.partitionBy("asset").orderBy("ts")
    d = base.daily_basics(spark, sf_dir).withColumn("p", F.lag("close").over(t)).withColumn("c5", F.lead("close", 4).over(t))
    return d.where("idx % 50 = 0").select("asset", "ts", _r(col("close") / col("p") - 1).alias("reaction_1"), _r(col("c5") / col("p") - 1).alias("reaction_5"))


@register("feature_sets", f"WITH {_LBL}, f AS (SELECT asset, ts, r1, tr FROM db) SELECT asset, ts, round({_norm('r1')}, 6) + 0.0 AS r1, (r1 IS NULL)::INT AS r1_missing, round(tr, 4) AS tr FROM f")
def feature_sets(spark, sf_dir):
    """Groups of columns, each ranked within the date or raw, with flags for missing values."""
    d = base.daily_basics(spark, sf_dir)
    return d.select("asset", "ts", _r(X.rank_normalise("r1", ["ts"])).alias("r1"), col("r1").isNull().cast("int").alias("r1_missing"), F.round("tr", 4).alias("tr"))


@register("training_matrix_equity", f"WITH {_LBL}, x AS (SELECT d.asset, d.ts, d.close / lag(d.close, 21) OVER o - 1 AS ret_21, l.label, l.vol FROM db d JOIN l USING (asset, ts) WINDOW o AS (PARTITION BY d.asset ORDER BY d.ts)) SELECT asset, ts, round({_norm('ret_21')}, 6) + 0.0 AS ret_21, (ret_21 IS NULL)::INT AS ret_21_missing, round(label, 6) + 0.0 AS label, round(CASE WHEN vol > 0 THEN label / vol END, 6) + 0.0 AS label_risk, round(1.0 / count(*) OVER (PARTITION BY ts), 6) AS weight FROM x")
def training_matrix_equity(spark, sf_dir):
    """Ranked features with flags; a row without an outcome stays, its labels null."""
    t, w = Trailing("asset"), Window.partitionBy("ts")
    x = base.daily_basics(spark, sf_dir).select("asset", "ts", t.ret(21).alias("ret_21")).join(labels(spark, sf_dir), ["asset", "ts"])
    return x.select("asset", "ts", _r(X.rank_normalise("ret_21", ["ts"])).alias("ret_21"), col("ret_21").isNull().cast("int").alias("ret_21_missing"), _r(col("label")).alias("label"), _r(F.when(col("vol") > 0, col("label") / col("vol"))).alias("label_risk"), F.round(1 / F.count("*").over(w), 6).alias("weight"))


@register("training_matrix_minute", f"WITH {base.HB}, x AS (SELECT h.asset, h.ts, h.idx, ln(h.close / lag(h.close, 3) OVER (PARTITION BY h.asset ORDER BY h.ts)) AS ret_3, 1e4 * ln(f.close / h.close) AS fwd FROM hb h LEFT JOIN hb f ON f.asset = h.asset AND f.ts = h.ts + INTERVAL 2 HOUR) SELECT asset, ts, round(ret_3, 6) + 0.0 AS ret_3, round(fwd, 4) + 0.0 AS fwd FROM x WHERE (idx - 1) % 5 = 0 AND ret_3 IS NOT NULL AND fwd IS NOT NULL")
def training_matrix_minute(spark, sf_dir):
    """Features, forward labels at exact instants, every fifth row, complete cases only."""
    h = base.hourly_basics(spark, sf_dir).withColumn("ret_3", Trailing("asset").logret(3))
    x = forward_exact(h, ["asset"], "ts", 7200, "close", "later").withColumn("fwd", 1e4 * F.log(col("later") / col("close")))
    return x.where("(idx - 1) % 5 = 0").dropna(subset=["ret_3", "fwd"]).select("asset", "ts", _r(col("ret_3")).alias("ret_3"), (F.round("fwd", 4) + 0.0).alias("fwd"))


@register("resume_from_mark", "SELECT event_id, user_id FROM events")
def resume_from_mark(spark, sf_dir):
    """A stream stopped after its data and started again from the same checkpoint adds no row twice."""
    path = ST.shared_path(spark, "resume")
    rows = ST.event_stream(spark, sf_dir).select("event_id", "user_id")
    for _ in range(2):
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@register("read_kline_csv", f"WITH {base.HB0} SELECT asset, ts, open, high, low, close, volume, quote_volume, trades FROM hb0")
def read_kline_csv(spark, sf_dir):
    """Bars written as CSV files by asset, some with a heading, times in seconds, milliseconds or microseconds, lines repeated; read back strictly."""
    b, path = base.hourly(spark, sf_dir), ST.shared_path(spark, "klines")
    s = F.unix_seconds(col("ts").cast("timestamp"))
    unit = F.pmod(F.floor(s / 3600), F.lit(3))
    time = F.when(unit == 0, s).when(unit == 1, s * 1000).otherwise(s * 1_000_000)
    text = lambda x: col(x).cast("string").alias(x)
    rows = b.select("asset", time.cast("string").alias("open_time"), *map(text, ("open", "high", "low", "close", "volume")), F.lit("0").alias("close_time"), text("quote_volume"), text("trades"), F.lit("x").alias("rest"))
    rows.union(rows.where(unit == 1)).write.partitionBy("asset").csv(f"{path}/a", header=True)
    rows.where("asset = 'CLICK'").write.partitionBy("asset").csv(f"{path}/b")
    both = [R.read_kline_csv(spark, f"{path}/{x}", col("asset"), 3600) for x in ("a", "b")]
    out = both[0].union(both[1]).dropDuplicates(["asset", "ts_utc"])
    return out.select("asset", base.ntz(col("ts_utc")).alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "trades")


@register("read_matrix", f"WITH {base.MX} SELECT asset, strftime(ts, '%Y-%m') AS month, price, qty FROM mx")
def read_matrix(spark, sf_dir):
    """A matrix written as JSON lines with its manifest among them, and read back with the features that the manifest names."""
    path = f"{ST.shared_path(spark, 'matrix')}/m"
    none = lambda kind: F.lit(None).cast(kind)
    rows = base.monthly(spark, sf_dir).select(none("string").alias("kind"), none("string").alias("version"), none("array<string>").alias("features"), "asset", F.date_format("ts", "yyyy-MM").alias("month"), "price", "qty")
    manifest = spark.range(1).select(F.lit("manifest").alias("kind"), F.lit("1").alias("version"), F.array(F.lit("price"), F.lit("qty")).alias("features"), none("long"), none("string"), none("double"), none("double"))
    R.write_jsonl(rows.union(manifest), path)
    data, head = R.read_matrix(spark, path, "asset long, month string, price double, qty double")
    return data.select("asset", "month", *B.validate_selection(data, head.first().features))
