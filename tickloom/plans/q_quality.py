"""Queries for validation, inventory, sources as column jobs, and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import quality as Q
from ..registry import register
from ..sources import readers as R
from ..sources import store as ST
from ..sources.staging import shared_path
from . import base
from .base import ntz, table

col = F.col


@register("validate_bars", f"WITH {base.HB0} SELECT CASE WHEN NOT regexp_full_match(asset, '[A-Z0-9]{{1,20}}') THEN 'asset' WHEN least(open, high, low, close) <= 0.05 THEN 'price' WHEN volume < 2 THEN 'volume' WHEN low > least(open, close) OR high < greatest(open, close) THEN 'range' ELSE 'ok' END AS reason, count(*) AS n FROM hb0 GROUP BY 1")
def validate_bars(spark, sf_dir):
    shifted = base.hourly(spark, sf_dir).withColumn("volume", col("volume") - 2)
    for p in ("open", "high", "low", "close"):
        shifted = shifted.withColumn(p, col(p) - 0.05)
    return shifted.groupBy(F.coalesce(B.violation(), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@register("assert_unique_ordered", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def assert_unique_ordered(spark, sf_dir):
    return B.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("canonical_filter", "SELECT p_partkey FROM part WHERE regexp_full_match(upper(replace(p_brand, '#', '')), '[A-Z0-9]{1,20}')")
def canonical_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(S.canonical(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))))).select("p_partkey")


@register("leveraged_filter", "SELECT p_partkey FROM part WHERE NOT (upper(p_name) LIKE '%UP' OR upper(p_name) LIKE '%DOWN' OR upper(p_name) LIKE '%BEAR' OR upper(p_name) LIKE '%BULL')")
def leveraged_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(~S.leveraged(F.upper("p_name"))).select("p_partkey")


@register("symbol_alias", "SELECT DISTINCT p_brand, CASE WHEN p_brand = 'Brand#3' THEN NULL WHEN p_brand LIKE 'Brand#1%' THEN '1000' || upper(replace(p_brand, '#', '')) || 'USDT' ELSE upper(replace(p_brand, '#', '')) || 'USDT' END AS symbol FROM part")
def symbol_alias(spark, sf_dir):
    name = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    asset = F.when(col("p_brand") == "Brand#3", "DENIED").when(col("p_brand").startswith("Brand#1"), F.concat(F.lit("k"), name)).otherwise(name)
    return table(spark, sf_dir, "part").select("p_brand", S.venue_symbol(asset, ["DENIED"]).alias("symbol")).distinct()


@register("inventory", f"WITH {base.HB0} SELECT asset, count(*) AS n, min(ts) AS first, max(ts) AS last FROM hb0 GROUP BY 1")
def inventory(spark, sf_dir):
    return base.hourly(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@register("content_hash")
def content_hash(spark, sf_dir):
    return Q.content_hash(base.hourly(spark, sf_dir), ["asset"])


_GAPS = f"WITH {base.HB}, g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts)) AS dt FROM hb)"


@register("continuity", f"{_GAPS} SELECT asset, count(*) FILTER (dt = 3600) AS adjacent, count(*) FILTER (dt = 3600 AND abs(open / pc - 1) > 0.5) AS breaks, round(max(abs(open / pc - 1)) FILTER (dt = 3600), 6) AS worst FROM g GROUP BY 1")
def continuity(spark, sf_dir):
    g = Q.adjacent(base.hourly_basics(spark, sf_dir), ["asset"], 3600)
    return g.groupBy("asset").agg(F.count("gap").alias("adjacent"), F.count_if(col("gap") > 0.5).alias("breaks"), F.round(F.max("gap"), 6).alias("worst"))


@register("continuity_breaks", f"{_GAPS} SELECT asset, ts, round(abs(open / pc - 1), 6) AS gap FROM g WHERE dt = 3600 AND abs(open / pc - 1) > 0.5")
def continuity_breaks(spark, sf_dir):
    g = Q.adjacent(base.hourly_basics(spark, sf_dir), ["asset"], 3600)
    return g.where("gap > 0.5").select("asset", "ts", F.round("gap", 6).alias("gap"))


@register("timestamp_grid", "SELECT event_type, count(*) FILTER (epoch_us(ts) % 3600000000 <> 0) AS off_grid, count(*) - count(DISTINCT ts) AS repeated FROM events GROUP BY 1")
def timestamp_grid(spark, sf_dir):
    us = F.unix_micros(col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(us % 3_600_000_000 != 0).alias("off_grid"), (F.count("*") - F.countDistinct("ts")).alias("repeated"))


@register("interval_alignment", f"WITH {base.HB0}, h AS (SELECT asset, ts::DATE AS day, arg_min(open, ts) AS o, max(high) AS hi, min(low) AS lo, arg_max(close, ts) AS c, count(*) AS n FROM hb0 GROUP BY 1, 2), d AS (SELECT upper(event_type) AS asset, ts::DATE AS day, arg_min(value, {{'a': e.ts, 'b': event_id}}) AS o, max(value) AS hi, min(value) AS lo, arg_max(value, {{'a': e.ts, 'b': event_id}}) AS c FROM events e GROUP BY 1, 2) SELECT asset, count(*) FILTER (n = 24) AS complete, count(*) FILTER (n < 24) AS incomplete, count(*) FILTER (n = 24 AND (h.o <> d.o OR h.hi <> d.hi OR h.lo <> d.lo OR h.c <> d.c)) AS mismatches FROM d JOIN h USING (asset, day) GROUP BY 1")
def interval_alignment(spark, sf_dir):
    h = base.hourly(spark, sf_dir).groupBy("asset", col("ts").cast("date").alias("day")).agg(F.struct(F.min_by("open", "ts"), F.max("high"), F.min("low"), F.max_by("close", "ts")).alias("h"), F.count("*").alias("n"))
    k = F.struct("ts", "event_id")
    d = table(spark, sf_dir, "events").groupBy(F.upper("event_type").alias("asset"), col("ts").cast("date").alias("day")).agg(F.struct(F.min_by("value", k), F.max("value"), F.min("value"), F.max_by("value", k)).alias("d"))
    return d.join(h, ["asset", "day"]).groupBy("asset").agg(F.count_if(col("n") == 24).alias("complete"), F.count_if(col("n") < 24).alias("incomplete"), F.count_if((col("n") == 24) & (col("h") != col("d"))).alias("mismatches"))


@register("coverage_starts", "SELECT min(o_orderdate) FILTER (o_orderstatus = 'F') AS f, min(o_orderdate) FILTER (o_totalprice > 400000) AS large, min(o_orderdate) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders")
def coverage_starts(spark, sf_dir):
    first = lambda cond: F.min(F.when(cond, col("o_orderdate")))
    return table(spark, sf_dir, "orders").agg(first(col("o_orderstatus") == "F").alias("f"), first(col("o_totalprice") > 400_000).alias("large"), first(col("o_orderpriority") == "1-URGENT").alias("urgent"))


@register("spread_coverage", "SELECT count(DISTINCT o_custkey) AS measured, count(DISTINCT c_custkey) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
def spread_coverage(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(1))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left").agg(F.count("m").alias("measured"), F.count("*").alias("total"))


@register("metric_coverage", "SELECT count(nullif(l_discount, 0)) AS discount, count(nullif(l_tax, 0)) AS tax, count(*) FILTER (l_discount <> 0 OR l_tax <> 0) AS anyone, count(*) AS n FROM lineitem")
def metric_coverage(spark, sf_dir):
    d, t = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    return table(spark, sf_dir, "lineitem").agg(F.count(d).alias("discount"), F.count(t).alias("tax"), F.count(F.coalesce(d, t)).alias("anyone"), F.count("*").alias("n"))


@register("attachment_audit", "SELECT CASE WHEN len(html) = 0 THEN 'empty' WHEN html LIKE '%<table%' THEN 'table' ELSE 'text' END AS status, count(*) AS n FROM pages GROUP BY 1")
def attachment_audit(spark, sf_dir):
    status = F.when(F.length("html") == 0, "empty").when(col("html").contains("<table"), "table").otherwise("text")
    return table(spark, sf_dir, "pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("stratified_sample", "WITH k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM k WHERE i * 10 // n <> (i - 1) * 10 // n OR i = 0")
def stratified_sample(spark, sf_dir):
    return Q.spread_sample(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 10).select("c_custkey", "c_mktsegment")


@register("consistent_merge", "SELECT l_partkey, count(*) AS inputs, max(l_extendedprice / l_quantity) - min(l_extendedprice / l_quantity) <= 1e-12 AS consistent FROM lineitem GROUP BY 1")
def consistent_merge(spark, sf_dir):
    v = col("l_extendedprice") / col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("inputs"), (F.max(v) - F.min(v) <= 1e-12).alias("consistent"))


@register("matrix_model_agreement", "WITH p AS (SELECT p_partkey, p_size % 4 = 0 AS f, p_size % 3 = 0 AS v, p_size % 5 = 0 AS l FROM part) SELECT p_partkey, NOT f AS features_agree, NOT v AS version_agrees, NOT l AS label_agrees, NOT (f OR v OR l) AS agrees FROM p")
def matrix_model_agreement(spark, sf_dir):
    """Feature list (in order), version and label of each model's document against the matrix it was made for; here one of each for every part."""
    s = col("p_size")
    name = lambda k: F.concat(F.lit(f"f{k}_"), col("p_brand"))
    doc = lambda features, version, label: F.to_json(F.struct(features.alias("features"), version.alias("version"), label.alias("label")))
    matrix = doc(F.array(name(1), name(2)), F.lit("2"), F.lit("fwd_15"))
    model = doc(F.when(s % 4 == 0, F.array(name(2), name(1))).otherwise(F.array(name(1), name(2))), F.when(s % 3 == 0, "1").otherwise("2"), F.when(s % 5 == 0, "fwd_60").otherwise("fwd_15"))
    kind = "features array<string>, version string, label string"
    both = table(spark, sf_dir, "part").select("p_partkey", F.from_json(matrix, kind).alias("matrix"), F.from_json(model, kind).alias("model"))
    same = [(col(f"matrix.{x}").eqNullSafe(col(f"model.{x}"))).alias(n) for x, n in (("features", "features_agree"), ("version", "version_agrees"), ("label", "label_agrees"))]
    return both.select("p_partkey", *same).withColumn("agrees", col("features_agree") & col("version_agrees") & col("label_agrees"))


@register("staleness_gate", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT user_id, epoch(m.t - max(ts)) > 2 * 86400 AS stale FROM events, m GROUP BY user_id, m.t")
def staleness_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("t"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(newest))
    us = lambda x: F.unix_micros(col(x).cast("timestamp"))
    return last.select("user_id", (us("t") - us("last") > 2 * 86_400_000_000).alias("stale"))


@register("degenerate_features", f"WITH {base.MX}, g AS (SELECT ts, max(price) - min(price) AS a, max(n - n) - min(n - n) AS b FROM mx GROUP BY 1) SELECT count(*) FILTER (a <> 0) AS price_varies, count(*) FILTER (b <> 0) AS constant_varies FROM g")
def degenerate_features(spark, sf_dir):
    g = base.monthly(spark, sf_dir).groupBy("ts").agg((F.max("price") - F.min("price")).alias("a"), (F.max(col("n") - col("n")) - F.min(col("n") - col("n"))).alias("b"))
    return g.agg(F.count_if(col("a") != 0).alias("price_varies"), F.count_if(col("b") != 0).alias("constant_varies"))


# ---------------------------------------------------------------- sources as column jobs


@register("scan_bars", f"WITH {base.HB0} SELECT asset, ts, close FROM hb0 ORDER BY asset, ts")
def scan_bars(spark, sf_dir):
    return base.hourly(spark, sf_dir).select("asset", "ts", "close").orderBy("asset", "ts")


@register("scan_asset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_asset(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@register("list_assets", "SELECT DISTINCT upper(event_type) AS asset FROM events WHERE regexp_full_match(upper(event_type), '[A-Z0-9]{1,20}')")
def list_assets(spark, sf_dir):
    return R.list_assets(table(spark, sf_dir, "events").select(F.upper("event_type").alias("asset")))


@register("scan_funding", "SELECT user_id, ts::DATE AS day, round(sum(value), 6) AS rate FROM events WHERE event_type = 'signup' GROUP BY 1, 2")
def scan_funding(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id", col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("rate"))


@register("upsert_bars", "WITH o AS (SELECT o_custkey, o_orderdate, max(o_totalprice) FILTER (o_orderstatus <> 'F') AS old, max(o_totalprice) FILTER (o_orderstatus = 'F') AS new FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderdate, coalesce(new, old) AS o_totalprice FROM o")
def upsert_bars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return R.upsert(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus"), ["o_custkey", "o_orderdate"])


@register("upsert_store", f"""WITH d AS (SELECT 'P' || substr(o_orderpriority, 1, 1) AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderstatus = 'F' AS late, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS trades FROM orders GROUP BY 1, 2, 3),
  a AS (SELECT asset, ts, arg_max(close, late) AS close, arg_max(trades, late) AS trades FROM d WHERE NOT late OR asset IN ('P1', 'P2') GROUP BY 1, 2)
  SELECT asset, ts, close, trades, CASE WHEN asset IN ('P1', 'P2') THEN 2 ELSE 1 END::BIGINT AS version FROM a""")
def upsert_store(spark, sf_dir):
    """Daily bars written to a store, those of two assets then replaced where closed orders have bars: one version, all at once."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("asset"), F.date_trunc("day", "o_orderdate").cast("timestamp").alias("ts_utc"), (col("o_orderstatus") == "F").alias("late"), "o_orderkey", col("o_totalprice").alias("p"))
    none = lambda c: F.lit(None).cast("double").alias(c)
    bars = o.groupBy("asset", "ts_utc", "late").agg(F.max_by("p", "o_orderkey").alias("close"), F.count("*").alias("trades"))
    bars = bars.select("ts_utc", "asset", F.lit(86_400).alias("interval_s"), none("open"), none("high"), none("low"), "close", none("volume"), none("quote_volume"), "trades", "late")
    path = shared_path(spark, "store")
    ST.replace(bars.where("not late"), path)
    ST.merge(bars.where("late and asset in ('P1', 'P2')"), path)
    held = ST.scan(spark, path, 86_400).join(F.broadcast(ST.partitions(spark, path).select("asset", "version")), "asset")
    return held.select("asset", ntz(col("ts_utc")).alias("ts"), "close", "trades", "version")


@register("epoch_unit", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS t FROM events")
def epoch_unit(spark, sf_dir):
    s = F.unix_seconds(col("ts").cast("timestamp"))
    raw = F.when(col("event_id") % 3 == 0, s).when(col("event_id") % 3 == 1, s * 1000).otherwise(s * 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", ntz(S.epoch_timestamp(raw)).alias("t"))


@register("read_book_depth", "WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS minute, event_type AS band, ts, value, user_id FROM events WHERE event_type IN ('view', 'click')), k AS (SELECT *, rank() OVER (PARTITION BY user_id % 10, minute ORDER BY ts DESC) AS r FROM e) SELECT (user_id % 10) AS book, minute, max(band) AS band, max(value) AS value FROM k WHERE r = 1 GROUP BY 1, 2")
def read_book_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((col("user_id") % 10).alias("book"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_type", "value").where(col("event_type").isin("view", "click"))
    top = e.withColumn("k", F.rank().over(Window.partitionBy("book", "hour").orderBy(F.desc("ts")))).where("k = 1")
    return top.groupBy("book", ntz(col("hour")).alias("minute")).agg(F.max("event_type").alias("band"), F.max("value").alias("value"))


@register("read_funding_events", "SELECT user_id, ts::DATE AS day, arg_min(value, {'a': ts, 'b': event_id}) AS rate FROM events GROUP BY 1, 2")
def read_funding_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", col("ts").cast("date").alias("day"), "ts", "event_id", "value")
    return R.first_per_key(e, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", col("value").alias("rate"))


@register("merge_funding", "WITH a AS (SELECT user_id, ts::DATE AS day, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, ts::DATE AS day, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT user_id, day, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (user_id, day)")
def merge_funding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", col("ts").cast("date"))
    side = lambda k: e.where(col("event_id") % 2 == k).groupBy("user_id", "day").agg(F.max("value").alias("v"))
    return R.upsert(side(0), side(1), ["user_id", "day"])


@register("read_metrics", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT % 5 <> 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS metric FROM events")
def read_metrics(spark, sf_dir):
    """Numbers from text fields; a blank is null, not zero."""
    k = F.from_json("props", "k int")["k"]
    text = F.when(k % 5 == 0, "").otherwise(k.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.nullif(text, F.lit("")).cast("double").alias("metric"))


@register("read_jsonl_props", "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def read_jsonl_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k int", {"mode": "FAILFAST"})["k"].alias("k")).agg(F.count("*").alias("n"))


@register("read_html_messages", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INT AS links, len(regexp_extract_all(html, '(?is)<tr\b'))::INT AS table_rows FROM pages""")
def read_html_messages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(R.html_links("html")).alias("links"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b"), F.lit(0))).alias("table_rows"))


_HTML_TEXT = r"""WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
  b AS (SELECT page_id, coalesce(nullif(regexp_extract(h, '(?is)<div[^>]*id="view-body"[^>]*>(.*?)</div>', 1), ''), nullif(regexp_extract(h, '(?is)<pre\b[^>]*>(.*?)</pre>', 1), ''), nullif(regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body>', 1), ''), h) AS b FROM h),
  t AS (SELECT page_id, regexp_replace(regexp_replace(b, '(?is)<[^>]*>', ' ', 'g'), '[\s\x0b]+', ' ', 'g') AS t FROM b)
  SELECT page_id, trim(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS text FROM t"""


@register("read_html_text", _HTML_TEXT)
def read_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.html_text("html").alias("text"))


@register("read_listing_history", "SELECT o_orderkey AS page_id, 0 AS \"row\", 'Company' AS company, NULL::DATE AS effective, 'other' AS kind FROM orders UNION ALL SELECT o_orderkey, 1, 'Company ' || o_custkey, o_orderdate::DATE, CASE o_orderstatus WHEN 'F' THEN 'delisting' WHEN 'O' THEN 'listing' ELSE 'change' END FROM orders")
def read_listing_history(spark, sf_dir):
    """Tables of notices, one page for every order: a heading and a row of company, event and date in words."""
    event = F.when(col("o_orderstatus") == "F", "Delisted &amp; gone").when(col("o_orderstatus") == "O", "Listed").otherwise("Name changed")
    td = lambda *xs: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td class='c'> "), x, F.lit("</td>")) for x in xs), F.lit("</tr>"))
    html = F.concat(F.lit("<html><table><tr><th>Company</th><th>Event</th><th>Day</th></tr>"), td(F.concat(F.lit("Company <b>"), col("o_custkey").cast("string"), F.lit("</b>")), event, F.date_format("o_orderdate", "d MMMM yyyy")), F.lit("<tr><td>end</td></tr></table></html>"))
    cells = table(spark, sf_dir, "orders").select(col("o_orderkey").alias("page_id"), F.posexplode(R.html_cells(html)).alias("row", "cells")).where("size(cells) >= 2")
    kind = S.classify_text(F.array_join("cells", " "), [("delisting", "delist|avnoter"), ("listing", "list|noter"), ("change", "chang|byt")])
    return cells.select("page_id", "row", F.get("cells", F.lit(0)).alias("company"), S.parse_date_text(F.array_join("cells", " ")).alias("effective"), kind.alias("kind"))


@register("read_equity_notice", """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN '' ELSE 'PG' || page_id END AS short_names, CASE WHEN page_id % 5 = 4 THEN '' WHEN page_id % 2 = 0 THEN 'SE0000108656,US0378331005' ELSE 'SE0000108656' END AS isins,
    CASE WHEN page_id % 5 = 4 THEN '' ELSE page_id::VARCHAR END AS order_book_ids, CASE WHEN page_id % 5 <> 4 AND page_id % 3 = 0 THEN DATE '2023-05-01' + (page_id % 200)::INT END AS first_day,
    CASE WHEN page_id % 5 <> 4 AND page_id % 3 <> 0 THEN DATE '2023-05-01' + (page_id % 200)::INT END AS last_day, CASE WHEN page_id % 5 = 4 THEN 'other' WHEN page_id % 3 = 0 THEN 'listing' ELSE 'delisting' END AS kind FROM pages""")
def read_equity_notice(spark, sf_dir):
    """The pages, four of five with a notice in their view body: labelled cells, and a day in a cell or in words; the fifth has an empty one."""
    k, day = col("page_id"), F.date_format(F.date_add(F.to_date(F.lit("2023-05-01")), (col("page_id") % 200).cast("int")), "d MMMM yyyy")
    td = lambda *xs: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in xs), F.lit("</tr>"))
    cells = td(F.lit("Short name"), F.concat(F.lit("PG"), k.cast("string")), F.lit("Order book ID"), F.concat(k.cast("string"), F.lit(" (new)")))
    isins = td(F.lit("ISIN"), F.when(k % 2 == 0, "SE0000108656 / US0378331005").otherwise("SE0000108656 / US0378331006"))
    first = F.concat(F.lit("Listing of the share"), td(F.lit("First day of trading"), day))
    last = F.concat(F.lit("Delisting: the share was delisted on "), day)
    notice = F.when(k % 5 == 4, "nothing new").otherwise(F.concat(F.lit("<table>"), cells, isins, F.when(k % 3 == 0, first).otherwise(last), F.lit("</table>")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<div id="view-body">'), notice, F.lit("</div>"), F.coalesce("html", F.lit(""))).alias("html"))
    text = [F.array_join(x, ",").alias(x) for x in ("short_names", "isins", "order_book_ids")]
    return R.notices(pages, "html").select("page_id", *text, "first_day", "last_day", S.classify_text(R.html_text("html"), R.NOTICE_KINDS).alias("kind"))


@register("read_notice_tables", """SELECT p_partkey AS id, upper(p_name) AS short_names, CASE WHEN p_partkey % 3 = 0 THEN 'SE0000108656,US0378331005' ELSE 'US0378331005' END AS isins,
    p_partkey::VARCHAR AS order_book_ids, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-01-01' + p_size::INT END AS first_day, DATE '2024-03-01' + p_size::INT AS last_day,
    ['delisting', 'segment_change', 'identity_change', 'resumption', 'suspension', 'listing', 'other'][(p_partkey % 7 + 1)::INT] AS kind FROM part""")
def read_notice_tables(spark, sf_dir):
    """One notice for every part: labelled cells in its view body, the last day in words, a false ISIN and other cells beside."""
    heads = ["De-listing of", "Transfer to Nasdaq Stockholm:", "Change of name for", "Lift of suspension in", "Trading halt in", "Listing of", "Report of"]
    td = lambda *xs: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td> "), x, F.lit("</td>")) for x in xs), F.lit("</tr>"))
    day = lambda first: F.date_format(F.date_add(F.to_date(F.lit(first)), col("p_size").cast("int")), "d MMMM yyyy")
    isins = F.when(col("p_partkey") % 3 == 0, "(SE0000108656), US0378331006").otherwise("US0378331006")
    rows = F.concat(td(F.lit("Short name:"), F.upper("p_name"), F.lit("Order book <i>ID</i>"), F.concat(col("p_partkey").cast("string"), F.lit(" x1"))), td(F.lit("ISIN code"), isins), F.when(col("p_partkey") % 2 == 0, td(F.lit("First day of trading"), day("2024-01-01"))).otherwise(td(F.lit("Note"))))
    html = F.concat(F.lit("<html><body><table>"), td(F.lit("Short name"), F.lit("outside")), F.lit('</table><div id="view-body"><table>'), rows, F.lit("</table><p>us0378331005; the last trading day is "), day("2024-03-01"), F.lit(".</p></div></body></html>"))
    # Parts are a few bytes in few files, their pages are long to read: they are dealt to all cores first.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    part = part.select(col("p_partkey").alias("id"), html.alias("html"), F.concat_ws(" ", F.get(F.array(*map(F.lit, heads)), (col("p_partkey") % 7).cast("int")), "p_name").alias("headline"))
    text = [F.array_join(x, ",").alias(x) for x in ("short_names", "isins", "order_book_ids")]
    return R.notices(part, "html").select("id", *text, "first_day", "last_day", S.classify_text("headline", R.NOTICE_KINDS).alias("kind"))


@register("dedupe_documents", "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def dedupe_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(col("text").cast("binary")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@register("read_market_history", f"WITH {base.HB0} SELECT asset, count(*) FILTER (high / low > 50) AS rejected, count(*) FILTER (high / low <= 50 AND open > close) AS crossed, count(*) AS n FROM hb0 GROUP BY 1")
def read_market_history(spark, sf_dir):
    """Rows that break the rule go aside with a reason, those with a low of zero too; a crossed quote is nulled, not dropped.

    An asset keeps its counts where all of its rows go aside.
    """
    good, bad = B.split_valid(base.hourly(spark, sf_dir), F.when(S.float_ratio("high", "low") > 50, "range"))
    quotes = good.withColumn("bid", F.when(col("open") <= col("close"), col("open")))
    kept = quotes.select("asset", F.lit(False).alias("rejected"), (col("bid").isNull() & col("open").isNotNull()).alias("crossed"))
    rows = kept.unionByName(bad.select("asset", F.lit(True).alias("rejected"), F.lit(False).alias("crossed")))
    return rows.groupBy("asset").agg(F.count_if("rejected").alias("rejected"), F.count_if("crossed").alias("crossed"), F.count("*").alias("n"))


@register("read_fi_positions", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.05 THEN l_discount * 100 END AS percent, l_discount < 0.05 AS below FROM lineitem")
def read_fi_positions(spark, sf_dir):
    """Percent as text: '<5' is a flag with a null percent."""
    text = F.when(col("l_discount") < 0.05, "<5").otherwise(F.replace(F.round(col("l_discount") * 100, 2).cast("string"), F.lit("."), F.lit(",")))
    rows = table(spark, sf_dir, "lineitem").withColumn("t", text)
    percent, below = R.threshold_percent("t")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", percent.alias("percent"), below.alias("below"))


@register("read_short_aggregate", "SELECT o_custkey AS lei, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def read_short_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("lei")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("latest"))


@register("read_index_history", f"WITH {base.DB0} SELECT asset, ts::DATE AS day, open AS start_value, close AS end_value FROM db0")
def read_index_history(spark, sf_dir):
    rows = base.daily(spark, sf_dir).select(F.to_json(F.struct("asset", col("ts").cast("date").alias("day"), col("open").alias("start_value"), col("close").alias("end_value"))).alias("j"))
    return rows.select(F.from_json("j", "asset string, day date, start_value double, end_value double").alias("r")).select("r.*")


@register("read_eod_bars", f"WITH {base.HB0} SELECT asset, ts::DATE AS day, arg_min(close, ts) AS close FROM hb0 WHERE high >= low AND volume >= 2 GROUP BY 1, 2")
def read_eod_bars(spark, sf_dir):
    return base.hourly(spark, sf_dir).where("high >= low and volume >= 2").groupBy("asset", col("ts").cast("date").alias("day")).agg(F.min_by("close", "ts").alias("close"))


@register("jdbc_operational", "SELECT event_type AS bot, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def jdbc_operational(spark, sf_dir):
    """The events in a database, read back by ranges of their key over four connections; newest rows by bot.

    The database lives in the driver's memory, so this query needs local mode; ``read_keyset`` doesn't.
    """
    url = f"jdbc:derby:memory:operational{uuid.uuid4().hex};create=true"
    table(spark, sf_dir, "events").select(col("event_type").alias("bot"), "event_id", "ts").coalesce(4).write.jdbc(url, "log", properties={"batchsize": "10000", "createTableColumnTypes": "bot VARCHAR(64)"})
    w = Window.partitionBy("bot").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = R.read_keyset(spark, url, "log", "event_id", 4)
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 20").select("bot", "event_id", ntz(col("ts")).alias("ts"))


# ---------------------------------------------------------------- scalars and text


@register("exchange_session", "WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS lt FROM events) SELECT event_id, (lt + INTERVAL 6 HOUR)::DATE AS session, CASE WHEN hour(lt) * 60 + minute(lt) >= 570 AND hour(lt) * 60 + minute(lt) < 975 THEN 'rth' WHEN hour(lt) >= 18 OR hour(lt) * 60 + minute(lt) < 570 THEN 'overnight' ELSE 'post' END AS segment FROM l")
def exchange_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("lt", S.exchange_time(col("ts").cast("timestamp")))
    return e.select("event_id", S.session_date("lt").alias("session"), S.session_segment("lt").alias("segment"))


@register("market_calendar", "WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS lt FROM events) SELECT event_id, NOT (isodow(lt) = 6 OR (isodow(lt) = 7 AND hour(lt) < 18) OR (isodow(lt) = 5 AND hour(lt) >= 17) OR hour(lt) = 17) AS open FROM l")
def market_calendar(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.market_open(S.exchange_time(col("ts").cast("timestamp"))).alias("open"))


@register("local_close_date", "WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Stockholm') AS a, ((ts + INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Stockholm') AS b FROM events) SELECT event_id, CASE WHEN hour(b) * 3600 + minute(b) * 60 + floor(second(b)) <= 63000 AND a::DATE = b::DATE THEN b::DATE END AS day FROM l")
def local_close_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.local_close_date(col("ts").cast("timestamp"), 3600).alias("day"))


@register("decimal_quantize", "SELECT o_orderkey, round_even(o_totalprice, 1)::DOUBLE AS q, (o_totalprice * 100)::BIGINT % 25 = 0 AS on_grid FROM orders")
def decimal_quantize(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.quantize("o_totalprice", 1).cast("double").alias("q"), S.on_grid("o_totalprice", "0.25").alias("on_grid"))


@register("normalize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x0b\f\r]+', ' ', 'g'), ' ?\n ?', E'\n', 'g'), '\n+', E'\n', 'g'), E' \n') AS text FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_text("text").alias("text"))


@register("classify_text", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'license' WHEN regexp_matches(lower(text), 'token|secret|password') THEN 'secret' WHEN regexp_matches(lower(text), 'the |and ') THEN 'english' ELSE 'other' END AS kind FROM documents")
def classify_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.classify_text("text", [("license", "license|copyright"), ("secret", "token|secret|password"), ("english", "the |and ")]).alias("kind"))


@register("parse_number", "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
def parse_number(spark, sf_dir):
    """Totals written in four locales and read back."""
    plain = F.format_number("o_totalprice", 2)
    swapped = F.translate(plain, ",.", " ,")
    dotted = F.translate(plain, ",.", ".,")
    text = F.when(col("o_orderkey") % 3 == 0, plain).when(col("o_orderkey") % 3 == 1, swapped).otherwise(dotted)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.parse_number(text), 2).alias("value"))


@register("parse_date_text", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def parse_date_text(spark, sf_dir):
    d = col("o_orderdate")
    text = F.when(col("o_orderkey") % 3 == 0, F.date_format(d, "d MMMM yyyy")).when(col("o_orderkey") % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_date_text(text).alias("day"))


@register("isin_valid", "WITH p AS (SELECT p_partkey, 'SE' || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10) AS isin FROM part), n AS (SELECT *, '2814' || isin[3:] AS d FROM p) SELECT p_partkey, isin, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END)) % 10 = 0 AS valid FROM n")
def isin_valid(spark, sf_dir):
    isin = F.concat(F.lit("SE"), F.lpad(col("p_partkey").cast("string"), 9, "0"), (col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", isin.alias("isin"), S.isin_valid(isin).alias("valid"))


@register("issuer_key", "SELECT s_suppkey, trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(s_name || ' AB ser. B'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND w NOT IN ('ab', 'publ')), ' '), '( (a|b|ser))+$', '')) AS key FROM supplier")
def issuer_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.issuer_key(F.concat("s_name", F.lit(" AB ser. B")), ["ab", "publ"], ["a", "b", "ser"]).alias("key"))


@register("extract_metric_pairs", "SELECT o_orderkey, round(floor(o_totalprice), 2) AS current, round(floor(o_totalprice / 2), 2) AS prior, round((floor(o_totalprice) - floor(o_totalprice / 2)) / nullif(floor(o_totalprice / 2), 0), 6) AS growth FROM orders")
def extract_metric_pairs(spark, sf_dir):
    text = F.concat(F.lit("Report. Net sales amounted to SEK "), F.floor("o_totalprice").cast("string"), F.lit(" ("), F.floor(col("o_totalprice") / 2).cast("string"), F.lit(") this year"))
    current, prior = S.pair_values(text, "net sales|nettoomsättning")
    return table(spark, sf_dir, "orders").select("o_orderkey", current.alias("current"), prior.alias("prior"), F.round(S.growth(current, prior), 6).alias("growth"))


@register("coalesce_supplements", "SELECT o_custkey, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'F'), max(o_totalprice) FILTER (o_orderstatus = 'O'), max(o_totalprice)) AS v FROM orders GROUP BY 1")
def coalesce_supplements(spark, sf_dir):
    part = lambda k: F.max(F.when(col("o_orderstatus") == k, col("o_totalprice")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(part("F"), part("O"), F.max("o_totalprice")).alias("v"))


@register("signed_value", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_orderpriority <> '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN -1 END END::INT AS direction FROM orders")
def signed_value(spark, sf_dir):
    nature = F.when(col("o_orderstatus") == "F", "Acquisition").when(col("o_orderstatus") == "O", "Disposal").otherwise("Gift")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.signed_direction(nature, (col("o_totalprice") > 1000) & (col("o_orderpriority") != "5-LOW")).alias("direction"))


@register("split_adaptive_ranges", "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY day) - n AS before FROM d) SELECT (before // 500)::BIGINT AS part, min(day) AS first, max(day) AS last, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def split_adaptive_ranges(spark, sf_dir):
    """A calendar cut into parts of about 500 rows (one row for each day)."""
    d = table(spark, sf_dir, "orders").groupBy(col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    c = d.withColumn("part", F.floor((F.sum("n").over(Window.orderBy("day")) - col("n")) / 500))
    return c.groupBy("part").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum("n").alias("n"))


# ---------------------------------------------------------------- events and fundamentals


@register("event_recency", "WITH e AS (SELECT user_id, ts::DATE AS day, event_type FROM events), d AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase') SELECT d.user_id, d.day, (d.day - max(e.day))::INT AS since, count(*) FILTER (e.day > d.day - 7) AS n_7 FROM d JOIN e ON e.user_id = d.user_id AND e.event_type = 'error' AND e.day < d.day GROUP BY 1, 2")
def event_recency(spark, sf_dir):
    return Q.event_recency(table(spark, sf_dir, "events"), "purchase", "error", 7)


@register("short_interest_state", "WITH e AS (SELECT user_id % 10 AS isin, user_id AS holder, ts, event_id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM events WHERE event_type = 'click') SELECT isin, ts, round(sum(value - was) OVER (PARTITION BY isin ORDER BY ts, event_id), 4) AS total FROM e")
def short_interest_state(spark, sf_dir):
    """Latest value of each holder carried on: the sum of the changes."""
    h = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("d", col("value") - F.coalesce(F.lag("value").over(h), F.lit(0.0))).withColumn("isin", col("user_id") % 10)
    return e.select("isin", "ts", F.round(F.sum("d").over(Window.partitionBy("isin").orderBy("ts", "event_id")), 4).alias("total"))


@register("fundamental_ratios", "SELECT o_custkey, round(arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) / nullif(sum(o_totalprice), 0), 6) AS to_assets, round((max(o_totalprice) - min(o_totalprice)) / abs(min(o_totalprice)), 6) AS growth FROM orders GROUP BY 1")
def fundamental_ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last"), F.sum("o_totalprice").alias("s"), F.max("o_totalprice").alias("a"), F.min("o_totalprice").alias("b"))
    return g.select("o_custkey", F.round(S.safe_ratio("last", "s"), 6).alias("to_assets"), F.round(S.growth("a", "b"), 6).alias("growth"))
