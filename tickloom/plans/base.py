"""Bars, crosses and tapes built from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import resample_ohlcv
from ..operators.windows import with_basics

PLACES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(x: Column) -> Column:
    return x.cast("timestamp_ntz")


def rounded(columns: dict[str, Column]) -> list[Column]:
    """Doubles rounded for comparison with SQL; negative zero becomes zero."""
    return [(F.round(v, PLACES) + F.lit(0.0)).alias(k) for k, v in columns.items()]


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events: asset = event type."""
    e = table(spark, sf_dir, "events").select(F.upper("event_type").alias("asset"), ntz(F.date_trunc("hour", "ts")).alias("hour"), "ts", "event_id", "value")
    return resample_ohlcv(e, ["asset"], F.col("hour"), "value", ["ts", "event_id"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the orders: asset = priority class."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("asset"), ntz(F.date_trunc("day", "o_orderdate")).alias("day"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return resample_ohlcv(o, ["asset"], F.col("day"), "price", ["o_orderkey"])


def hourly_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_basics(hourly(spark, sf_dir), "asset")


def daily_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_basics(daily(spark, sf_dir), "asset")


def exact_mean(x: str) -> Column:
    """Mean that no order of rows changes: a sum of whole millionths, divided once; a plain average where a value is 1e12 or more, or not finite."""
    small = F.abs(x) < 1e12
    whole = F.sum(F.when(small, F.floor(F.col(x) * 1_000_000 + 0.5))).cast("double")
    return F.when(F.bool_and(small), whole / (1_000_000 * F.count(x))).otherwise(F.avg(x))


def exact_mean_sql(x: str) -> str:
    """SQL of :func:`exact_mean`."""
    return f"CASE WHEN bool_and(abs({x}) < 1e12) THEN sum(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1000000 + 0.5)::BIGINT END)::DOUBLE / (1000000 * count({x})) ELSE avg({x}) END"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section: one row per supplier and month of line items.  Equal means are equal doubles, whatever the order of rows: ties and bounds depend on them."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), ntz(F.date_trunc("month", "l_shipdate")).alias("ts"))
    return x.agg(exact_mean("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"), exact_mean("l_discount").alias("disc"), exact_mean("l_tax").alias("tax"), F.count("*").alias("n"))


_BASICS = """
{v} AS (
  SELECT *, close / pc - 1 AS r1, ln(close / pc) AS lr,
         greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr
  FROM (SELECT *, row_number() OVER o AS idx, lag(close) OVER o AS pc FROM {v}0 WINDOW o AS (PARTITION BY asset ORDER BY ts)))"""
HB0 = """hb0 AS (
  SELECT upper(event_type) AS asset, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, {'a': e.ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, {'a': e.ts, 'b': event_id}) AS close, count(*)::DOUBLE AS volume, sum(value) AS quote_volume, count(*) AS trades
  FROM events e GROUP BY 1, 2)"""
DB0 = """db0 AS (
  SELECT 'P' || substr(o_orderpriority, 1, 1) AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume, sum(o_totalprice) AS quote_volume, count(*) AS trades
  FROM orders GROUP BY 1, 2)"""
HB, DB = HB0 + "," + _BASICS.format(v="hb"), DB0 + "," + _BASICS.format(v="db")
MX = f"""mx AS (
  SELECT l_suppkey AS asset, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, {exact_mean_sql("l_extendedprice")} AS price, sum(l_quantity) AS qty, {exact_mean_sql("l_discount")} AS disc, {exact_mean_sql("l_tax")} AS tax, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""
_SIZES = (5, 6, 14, 15, 20, 24, 30, 50, 60, 61, 72, 90, 126, 168, 200, 252)
WINDOWS = "WINDOW w AS (PARTITION BY asset ORDER BY ts), " + ", ".join(f"w{n} AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _SIZES)
WINDOWS += ", p20 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def select_sql(view: str, columns: dict[str, str], ctes: str, more: str = "") -> str:
    """SELECT asset, ts and rounded expressions over a view of bars, with the named windows."""
    listed = ", ".join(f"round({v}, {PLACES}) + 0.0 AS {k}" for k, v in columns.items())
    return f"WITH {ctes} SELECT asset, ts, {listed} FROM {view} {more} {WINDOWS}"
