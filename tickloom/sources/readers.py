"""Readers and writers: strict schemas, header-optional files, partitioned stores, upserts.

Reads fail on malformed rows unless the function says otherwise; invalid rows go to a side frame
with a reason, they are not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import c, epoch_timestamp, isin_valid, normalize_text, parse_date_text, parse_number

BARS = "ts_utc timestamp, asset string, interval_s int, open double, high double, low double, close double, volume double, quote_volume double, trades long"
BAR_COLUMNS = [field.split()[0] for field in BARS.split(", ")]
KLINE = "open_time string, open string, high string, low string, close string, volume string, close_time string, quote_volume string, trades string, rest string"


def list_assets(bars: DataFrame) -> DataFrame:
    return bars.select("asset").distinct().where(F.col("asset").rlike("^[A-Z0-9]{1,20}$"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both; per key the new row wins, and among rows of one side the largest."""
    both = old.withColumn("u_load", F.lit(0)).unionByName(new.withColumn("u_load", F.lit(1)), allowMissingColumns=True)
    values = [x for x in both.columns if x not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct("u_load", *[v for v in values if v != "u_load"])).alias("u"))
    return best.select(*keys, *(F.col(f"u.{v}").alias(v) for v in values if v != "u_load"))


def read_kline_csv(spark: SparkSession, paths: str | list[str], asset: Column, interval_s: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from header-optional CSV lines, from ``start`` on and before ``end``; the unit of the time goes by its size; one row for each time."""
    rows = spark.read.schema(KLINE).csv(paths).where(F.col("open_time").rlike("^[0-9]+$"))
    number = lambda x: F.col(x).cast("double").alias(x)
    bars = rows.select(epoch_timestamp(F.col("open_time").cast("long")).alias("ts_utc"), asset.alias("asset"), F.lit(interval_s).alias("interval_s"), *map(number, ("open", "high", "low", "close", "volume", "quote_volume")), F.col("trades").cast("long").alias("trades"))
    values = bars.columns[3:]
    if start is not None:
        bars = bars.where(F.col("ts_utc") >= F.lit(start).cast(bars.schema["ts_utc"].dataType))
    if end is not None:
        bars = bars.where(F.col("ts_utc") < F.lit(end).cast(bars.schema["ts_utc"].dataType))
    return bars.where("ts_utc is not null").groupBy("ts_utc", "asset", "interval_s").agg(F.min(F.struct(*values)).alias("v")).select("ts_utc", "asset", "interval_s", "v.*")


def read_csv(spark: SparkSession, paths: str | list[str], schema: str, **options) -> DataFrame:
    """Strict CSV: blank is null, a malformed line is an error."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", nullValue="", **options).csv(paths)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Strict JSON lines; a day whose file is missing has no coverage."""
    return spark.read.schema(schema).options(mode="FAILFAST", ignoreMissingFiles=True).json(paths)


def read_matrix(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines matrix, and its manifest (kind = 'manifest')."""
    rows = spark.read.schema(f"kind string, version string, features array<string>, {schema}").json(path)
    return rows.where("kind is null or kind <> 'manifest'").drop("kind", "version", "features"), rows.where("kind = 'manifest'").select("version", "features")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def newest_snapshot(rows: DataFrame, keys: list[str], ts: str, band: str, value: str, bands: list[str]) -> DataFrame:
    """Per key and minute, a map of bands of the newest snapshot in the minute (ties merge)."""
    kept = rows.where(F.col(band).isin(bands)).withColumn("minute", F.date_trunc("minute", ts))
    w = Window.partitionBy(*keys, "minute").orderBy(F.desc(ts))
    top = kept.withColumn("k", F.rank().over(w)).where("k = 1")
    return top.groupBy(*keys, "minute", band).agg(F.max(value).alias("v")).groupBy(*keys, "minute").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(band, "v")))).alias("bands"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [x for x in rows.columns if x not in keys and x not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("v")).select(*keys, "v.*")


def threshold_percent(text: str) -> tuple[Column, Column]:
    """(percent, below threshold): '<0.5' is a flag with a null percent."""
    below = c(text).startswith("<")
    return F.when(~below, parse_number(text)), below


def valid_isin_rows(rows: DataFrame, isin: str) -> DataFrame:
    """Rows, with an error for an ISIN that is not valid."""
    return rows.withColumn(isin, F.when(isin_valid(isin), F.col(isin)).otherwise(F.raise_error(F.concat(F.lit("not an ISIN: "), F.coalesce(F.col(isin), F.lit("null"))))))


def html_body(html) -> Column:
    """Markup of the view body, else preformatted text, else the body, without scripts, styles and comments."""
    h = F.regexp_replace(c(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    pick = lambda p: F.nullif(F.regexp_extract(h, p, 1), F.lit(""))
    return F.coalesce(pick(r'(?is)<div[^>]*id="view-body"[^>]*>(.*?)</div>'), pick(r"(?is)<pre\b[^>]*>(.*?)</pre>"), pick(r"(?is)<body\b[^>]*>(.*)</body>"), h)


def html_text(html) -> Column:
    """Visible text of a page's body; white space collapsed."""
    return _visible(html_body(html))


def _visible(markup: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(markup, r"(?is)<[^>]*>", " "), r"\s+", " ")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return F.trim(text)


def html_links(html) -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(c(html), F.lit(r'href="([^"]*)"'), F.lit(1)))


def html_cells(html) -> Column:
    """Rows of table cells as arrays of their text."""
    rows = F.regexp_extract_all(c(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    strip = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?is)<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip))


def xbrl_facts(rows: DataFrame, json: str, period_end: str) -> DataFrame:
    """Facts with exactly four dimensions and an IFRS concept, within three years before the report's end."""
    facts = rows.withColumn("fact", F.explode(F.map_values(F.from_json(json, "map<string, struct<value: string, dimensions: map<string, string>>>"))))
    d = F.col("fact.dimensions")
    end = F.coalesce(F.to_date(F.regexp_extract(d["period"], r"([0-9-]{10})[^/]*$", 1)), F.to_date(F.lit("0001-01-01")))
    kept = facts.where((F.size(d) == 4) & d["concept"].startswith("ifrs-full:")).withColumn("end", end)
    return kept.where(F.date_diff("end", period_end).between(-1100, 7)).select(*[x for x in rows.columns if x != json], d["concept"].alias("concept"), "end", d["unit"].alias("unit"), F.col("fact.value").alias("value")).distinct()


def statements(rows: DataFrame, json: str, sections: list[str]) -> DataFrame:
    """One row per period from the sections of a statement document; available when the latest was filed."""
    keys = [x for x in rows.columns if x != json]
    schema = ", ".join(f"{s}: map<string, struct<filing_date: string, amount: double>>" for s in sections)
    parsed = rows.withColumn("j", F.from_json(json, f"struct<{schema}>"))
    out = None
    for s in sections:
        part = parsed.select(*keys, F.explode(F.col(f"j.{s}")).alias("period", "v")).select(*keys, "period", F.col("v.amount").alias(s), F.col("v.filing_date").alias(f"{s}_filed"))
        out = part if out is None else out.join(part, [*keys, "period"], "full_outer")
    return out.withColumn("available", F.greatest(*(F.col(f"{s}_filed") for s in sections))).drop(*(f"{s}_filed" for s in sections)) if len(sections) > 1 else out.withColumnRenamed(f"{sections[0]}_filed", "available")


def report_body(text) -> Column:
    return normalize_text(text)


#: Phrases after which a notice gives a trading day.
FIRST_DAY = ["first day of trading", "first day for trading", "trading will commence", "admitted to trading on"]
LAST_DAY = ["last day of trading", "last day for trading", "last trading day", "delisted on"]
#: Headline phrases by kind of notice, the first kind that matches counts.
NOTICE_KINDS = [
    ("delisting", "delisting|de-listing|removal from nasdaq"),
    ("segment_change", "change of market segment|segment change|transfer to nasdaq stockholm"),
    ("identity_change", "change of company name|change of name|change of short name|change of ticker|change of isin|new company name"),
    ("resumption", "lift of suspension|resumption of trading|trading resumes"),
    ("suspension", "suspension|suspended|trading halt"),
    ("listing", "listing of|admission to trading|first day of trading|new share for trading"),
]


def tokens(text) -> Column:
    """Words in capitals, without marks at their ends."""
    return F.filter(F.transform(F.split(c(text), r"\s+"), lambda x: F.upper(F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))), lambda x: x != "")


def notice_pairs(html) -> Column:
    """Label (letters and digits in lower case) and value of each two neighbouring cells of a table row."""
    rows = F.filter(html_cells(html_body(html)), lambda r: F.size(r) >= 2)
    return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), F.floor(F.size(r) / 2).cast("int")), lambda i: F.struct(F.regexp_replace(F.lower(F.get(r, 2 * i - 2)), "[^a-z0-9]", "").alias("label"), F.get(r, 2 * i - 1).alias("value")))))


def trading_day(values: Column, text: Column, phrases: list[str]) -> Column:
    """The first date among ``values``, else one within 180 characters after the first of ``phrases`` that has one."""
    listed = F.get(F.filter(F.transform(values, parse_date_text), lambda d: d.isNotNull()), F.lit(0))
    lower = F.lower(text)
    after = [F.when(F.contains(lower, F.lit(p)), parse_date_text(F.substr(lower, F.locate(p, lower) + len(p), F.lit(180)))) for p in phrases]
    return F.coalesce(listed, *after)


def notices(pages: DataFrame, html: str) -> DataFrame:
    """Add short_names, isins, order_book_ids (sorted arrays), first_day and last_day, from labelled cells and, failing them, the text.

    A null page has empty arrays and no days.
    """
    p = pages.withColumn("n_pairs", F.coalesce(notice_pairs(html), F.array().cast("array<struct<label: string, value: string>>"))).withColumn("n_text", F.coalesce(html_text(html), F.lit("")))
    of = lambda pattern: F.transform(F.filter("n_pairs", lambda x: x["label"].rlike(pattern)), lambda x: x["value"])
    found = lambda a: F.array_sort(F.array_distinct(a))
    words = F.flatten(F.transform(of("orderbookid"), tokens))
    p = p.withColumns({
        "short_names": found(F.filter(of("shortname|shortcode"), lambda x: x != "")),
        "isins": found(F.filter(tokens("n_text"), isin_valid)),
        "order_book_ids": found(F.filter(words, lambda x: x.rlike("^[0-9]+$"))),
        "first_day": trading_day(of("firstdayoftrading"), F.col("n_text"), FIRST_DAY),
        "last_day": trading_day(of("lastdayoftrading"), F.col("n_text"), LAST_DAY),
    })
    return p.drop("n_pairs", "n_text")


def recent(spark: SparkSession, url: str, table: str, order: str, id: str, limit: int, *, quote: str = '"', **options) -> DataFrame:
    """Newest rows of an operational table over JDBC, at most ``limit``: the database sorts and cuts, Spark reads ``limit`` rows."""
    name = lambda x: f"{quote}{x.replace(quote, 2 * quote)}{quote}"
    newest = f"SELECT * FROM {table} ORDER BY {name(order)} DESC, {name(id)} DESC FETCH FIRST {int(limit)} ROWS ONLY"
    return spark.read.format("jdbc").options(**{**options, "url": url, "query": newest}).load()


def read_keyset(spark: SparkSession, url: str, table: str, id: str, connections: int, *, quote: str = '"', **options) -> DataFrame:
    """A whole operational table over JDBC, by ranges of a numeric key between the bounds the database tells; one connection for each.

    Rows whose key is null come with the first range; an empty table gives no row.
    """
    name = f"{quote}{id.replace(quote, 2 * quote)}{quote}"
    ends = spark.read.format("jdbc").options(**{**options, "url": url, "query": f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}"}).load().first()
    rows = spark.read.format("jdbc").options(**{**options, "url": url, "dbtable": table})
    if ends[0] is not None and ends[0] < ends[1]:
        rows = rows.options(partitionColumn=name, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(connections))
    return rows.load()


#: Columns of insider reports by their headers (the misspelt one is the source's own), and what they are called here.
PDMR = {
    "Publication date": "publication",
    "Issuer": "issuer",
    "LEI-code": "lei",
    "Notifier": "notifier",
    "Person discharging managerial responsibilities": "pdmr",
    "Position": "position",
    "Closely associated": "closely_associated",
    "Amendment": "amendment",
    "Details of amendment": "amendment_details",
    "Initial notification": "initial_notification",
    "Linked to share option programme": "option_programme",
    "Nature of transaction": "nature",
    "Intrument type": "instrument_type",
    "Instrument name": "instrument_name",
    "ISIN": "isin",
    "Transaction date": "transaction",
    "Volume": "volume",
    "Unit": "unit",
    "Price": "price",
    "Currency": "currency",
    "Trading venue": "venue",
    "Status": "status",
}
_PDMR_CSV = {"header": True, "sep": ";", "encoding": "UTF-16LE", "escape": '"'}


def write_pdmr(rows: DataFrame, path: str) -> None:
    """Text columns named as in PDMR, written as UTF-16LE with semicolons."""
    rows.select(*(F.col(c).alias(h) for h, c in PDMR.items())).write.options(**_PDMR_CSV).csv(path)


def read_pdmr(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Insider reports: UTF-16LE files with semicolons and 22 named columns, in any order and among others; values may be quoted over lines.

    Days are day/month/year with a time; publication_time keeps its text.  'yes' and 'ja' are true.
    Blank numbers, ISINs and details are null, other blanks empty.  A missing column, a day or a
    number that can't be read is an error.  A file is read by one task.
    """
    raw = spark.read.options(**_PDMR_CSV, multiLine=True).csv(paths)
    raw = raw.toDF(*(h.lstrip("\ufeff").strip() for h in raw.columns))
    if missing := [h for h in PDMR if h not in raw.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    t = {c: F.trim(F.coalesce(F.col(f"`{h}`"), F.lit(""))) for h, c in PDMR.items()}
    wrong = lambda what, x: F.raise_error(F.concat(F.lit(f"not a {what}: "), x))

    def day(x: Column) -> Column:
        d = F.when(x.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} "), F.try_to_date(F.substring_index(x, " ", 1), "d/M/yyyy"))
        return F.coalesce(d, wrong("day", x).cast("date"))

    def number(x: Column) -> Column:
        n = F.regexp_replace(F.regexp_replace(x, "[\u00a0 ]", ""), ",", ".").try_cast("double")
        return F.when(x != "", F.when(F.abs(n) < float("inf"), n).otherwise(wrong("number", x).cast("double")))

    yes, blank = lambda x: F.lower(x).isin("yes", "ja"), lambda x: F.nullif(x, F.lit(""))
    made = {"closely_associated": yes, "amendment": yes, "initial_notification": yes, "option_programme": yes, "amendment_details": blank, "isin": blank, "volume": number, "price": number}
    columns = []
    for name, x in t.items():
        if name in ("publication", "transaction"):
            columns.append(day(x).alias(f"{name}_date"))
        else:
            columns.append(made.get(name, lambda v: v)(x).alias(name))
        if name == "publication":
            columns.append(F.substring(x, F.locate(" ", x) + 1, F.length(x)).alias("publication_time"))
    return raw.select(*columns)
