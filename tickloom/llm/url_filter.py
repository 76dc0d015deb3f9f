"""URL filters over time: dated list entries become validity intervals, captures meet those active.

A list is a log of additions and removals of keys (a host, a domain with what is below it, or a
host with the start of a path).  As-of joins look back from each capture's fetch time.  Running
values come in two levels, by key and day and then by day, and the captures of a hot key are dealt
over copies of its intervals, so that no host is gathered into one task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[^:]+://[^/?#]*((?:/[^/?#]+)*)"
DAY = 86_400_000_000
#: Captures of a key beyond this many are dealt over several copies of its intervals, together no more rows than its captures.
SALTED = 50_000
#: Listed keys up to this many (about 10 MB) are broadcast to find the captures that any list concerns, and as many hot keys; more are joined by shuffle.
BROADCAST_KEYS = 100_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url: Column) -> Column:
    """Keys under which a list may hold a URL: (kind, key) of its host, its domains and its paths; none for a URL without host.

    Domains are the host's last labels, from two to all of them, paths all starts of its steps: as many keys as the URL has parts.
    """
    host = host_of(url)
    labels, steps = F.split(host, r"\."), F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    some = lambda a, b: F.when(b >= a, F.sequence(F.lit(a), b)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(some(2, F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, -i, i), ".")))
    paths = F.transform(some(1, F.size(steps)), lambda i: pair("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.array(pair("host", host)), domains, paths)).otherwise(F.array().cast("array<struct<kind: string, key: string>>"))


def before(df: DataFrame, keys: list[str], time: str, tie: list[str], value: str, name: str, *, backward: bool = False) -> DataFrame:
    """Add the last ``value`` that is not null of earlier rows of the same keys (``backward``: the first of later rows)."""
    sign = -1 if backward else 1
    at = (sign * F.unix_micros(time)).alias("at")
    rows = df.withColumn("w_at", at).withColumn("w_day", F.floor(F.col("w_at") / DAY))
    order = [F.col("w_at"), *(F.desc(t) if backward else F.asc(t) for t in tie)]
    rows = rows.withColumn("w_own", F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "w_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    # Ties within a microsecond keep the rows' order: later in the order is larger.
    place = F.struct("w_at", *(F.col(t) if not backward else -F.col(t) for t in tie))
    days = rows.where(F.col(value).isNotNull()).groupBy(*keys, "w_day").agg(F.max_by(value, place).alias("w_tail"))
    every = rows.select(*keys, "w_day").distinct().join(days, [*keys, "w_day"], "left")
    carried = every.withColumn("w_carry", F.last("w_tail", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("w_day").rowsBetween(Window.unboundedPreceding, -1))).drop("w_tail")
    return rows.join(carried, [*keys, "w_day"]).withColumn(name, F.coalesce("w_own", "w_carry")).drop("w_at", "w_day", "w_own", "w_carry")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, valid_from, valid_to (null: still valid) from a log of list, kind, key, action and at.

    action is 'add' or 'remove'.  Adding what is listed, or removing what isn't, changes nothing; at
    one instant a removal wins.  Entries with a null in any of these columns, or another action, are
    ignored, and entries that repeat count once.  An empty log gives no interval.
    """
    keys = ["list", "kind", "key"]
    usual = entries.where(F.col("action").isin("add", "remove")).select(*keys, "at", F.when(F.col("action") == "add", 1).otherwise(0).alias("on")).dropna()
    events = usual.groupBy(*keys, "at").agg(F.min("on").alias("on"))
    changes = before(events, keys, "at", [], "on", "was").where(F.col("on") != F.coalesce("was", F.lit(0)))
    # Changes alternate: each addition ends at the next change.
    ends = before(changes.select(*keys, "at", "on", F.col("at").alias("w_end")), keys, "at", [], "w_end", "valid_to", backward=True)
    return ends.where("on = 1").select(*keys, F.col("at").alias("valid_from"), "valid_to")


def evaluate_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, fetched_at, blocked, n_active and blocked_since of every capture.

    A capture is blocked if an entry of list 'block' is active at its fetch time under any of its
    keys (from its start on, and before its end, to the microsecond) and none of list 'allow' is; n_active counts the active (list, kind, key), blocked_since is
    the latest start among the block entries.  Captures without URL, host or time are not blocked.
    Rows that repeat are captures of their own; other columns are ignored.
    """
    # Rows are known by their place in the written table.
    rows = stage(captures.select("page_id", "url", "fetched_at").withColumn("c_row", F.monotonically_increasing_id()), "captures")
    intervals = stage(validity_intervals(entries), "intervals")
    listed = intervals.select("kind", "key").distinct()
    few = listed.count() <= BROADCAST_KEYS
    probes = rows.where(F.col("fetched_at").isNotNull()).select("c_row", F.col("fetched_at").alias("at"), F.explode(keys_of(F.col("url"))).alias("k")).select("c_row", "at", "k.kind", "k.key")
    probes = stage(probes.join(F.broadcast(listed) if few else listed, ["kind", "key"], "left_semi"), "probes")
    # At most one row for each SALTED probes.
    hot = probes.groupBy("kind", "key").agg(F.count("*").alias("probes")).where(F.col("probes") > SALTED)
    spans = intervals.groupBy("kind", "key").agg(F.count("*").alias("spans"))
    copies = F.least(F.ceil(F.col("probes") / SALTED), F.floor(F.col("probes") / F.coalesce("spans", F.lit(1)))).cast("int")
    hot = stage(hot.join(spans, ["kind", "key"], "left").select("kind", "key", copies.alias("copies")).where("copies > 1"), "hot")
    few_hot = hot.count() <= BROADCAST_KEYS
    many = F.coalesce("copies", F.lit(1))
    salted = lambda df: df.join(F.broadcast(hot) if few_hot else hot, ["kind", "key"], "left")
    span = F.struct("valid_from", "valid_to")
    left = salted(probes).withColumn("salt", F.pmod(F.xxhash64("c_row"), many).cast("int")).withColumn("list", F.explode(F.array(F.lit("allow"), F.lit("block"))))
    left = left.select("list", "kind", "key", "salt", "at", F.lit(1).alias("side"), "c_row", F.lit(None).cast("struct<valid_from: timestamp, valid_to: timestamp>").alias("span"))
    right = salted(intervals).withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1)))
    right = right.select("list", "kind", "key", "salt", F.col("valid_from").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("c_row"), span.alias("span"))
    joined = before(left.union(right), ["list", "kind", "key", "salt"], "at", ["side"], "span", "seen").where("side = 1")
    active = joined.where(F.col("seen").isNotNull() & (F.col("seen.valid_from") <= F.col("at")) & (F.col("seen.valid_to").isNull() | (F.col("seen.valid_to") > F.col("at"))))
    by = active.groupBy("c_row").agg(F.count("*").alias("n"), F.max(F.when(F.col("list") == "block", F.col("seen.valid_from"))).alias("since"), F.max(F.when(F.col("list") == "allow", 1)).alias("allowed"))
    out = rows.join(by, "c_row", "left")
    blocked = F.col("since").isNotNull() & F.col("allowed").isNull()
    return out.select("page_id", "fetched_at", F.coalesce(blocked, F.lit(False)).alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.when(blocked, F.col("since")).alias("blocked_since"))
