"""Null rules, gaps, ties, prefix invariance, readers, folds, and every query against its SQL."""

import datetime as dt
import hashlib
import math
import os
import struct

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from tickloom.functions import scalars as S
from tickloom.operators import aggregates as A
from tickloom.operators import bars as B
from tickloom.operators import cross_section as X
from tickloom.operators import folds as O
from tickloom.operators import joins as J
from tickloom.operators import models as M
from tickloom.operators import quality as Q
from tickloom.operators import statistics as E
from tickloom.operators.windows import Trailing, with_basics
from tickloom.plans import load
from tickloom.sources import readers as R
from tickloom.sources import store as ST

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


def bars_of(spark, closes, asset="A", gaps=()):
    rows = []
    for i, c in enumerate(closes):
        if i not in gaps:
            rows.append((asset, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), c, c, c, c, 1.0, c, 1))
    return spark.createDataFrame(rows, "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long")


def close_of(n):
    out = [100.0]
    for i in range(n - 1):
        out.append(out[-1] * math.exp(0.01 * math.sin(0.7 * i) + 0.001))
    return out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.partition('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal":
            return repr(round(float(v), 9) + 0.0)
        return str(v).replace(" 00:00:00", "")

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine, theirs = plain(got.collect(), got.columns), plain(want.fetchall(), columns)
    assert len(mine) == len(theirs)
    assert mine == theirs, [(a, b) for a, b in zip(mine, theirs) if a != b][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("f", [lambda t: t.ret(5), lambda t: t.vol(10), lambda t: t.skew(10), lambda t: t.max_drawdown(10), lambda t: t.surge("volume", 5), lambda t: t.zscore(10, "quote_volume"), lambda t: t.dist_high(10)])
def test_prefix_invariance(spark, f):
    """Later rows never change earlier results."""
    closes, t = close_of(60), Trailing("asset")
    run = lambda n: {r.ts: r.v for r in with_basics(bars_of(spark, closes[:n]), "asset").select("ts", f(t).alias("v")).collect()}
    long, short = run(60), run(40)
    assert all(long[k] == v for k, v in short.items()) and any(v is not None for v in short.values())


def test_windows_poison_on_missing_values(spark):
    t = Trailing("asset")
    b = with_basics(bars_of(spark, [10.0, 11.0, 12.0, 13.0, 14.0, 15.0]), "asset").withColumn("x", F.when(F.col("idx") != 3, F.col("close")))
    got = [r.m for r in b.select("ts", t.clean(3, "x", t.median(3, "x")).alias("m")).orderBy("ts").collect()]
    assert got == [None, None, None, None, None, 14.0]
    flat = with_basics(bars_of(spark, [5.0, 5.0, 5.0]), "asset")
    assert [r.v for r in flat.select(t.skew(2, "r1").alias("v")).collect()] == [None] * 3
    assert flat.select(S.close_location().alias("a"), S.close_location(True).alias("b")).first() == (0.5, 0.0)


def test_asof_rules(spark):
    left = spark.createDataFrame([("k", 100), ("k", 200), ("k", 10**9), ("z", 100), (None, 100), ("k", None)], "k string, t long")
    right = spark.createDataFrame([("k", 100, 1.0), ("k", 100, 2.0), ("k", 150, 3.0), ("k", None, 9.0)], "k string, t long, v double")
    us = F.col("t") * 1_000_000
    run = lambda **o: {(r.k, r.t): r.h and r.h.v for r in J.asof_join(left, right, ["k"], us, us, "h", ["v"], **o).collect()}
    assert run() == {("k", 100): 2.0, ("k", 200): 3.0, ("k", 10**9): 3.0, ("z", 100): None, (None, 100): None, ("k", None): None}
    assert run(tolerance_s=50)[("k", 200)] == 3.0 and run(tolerance_s=49)[("k", 200)] is None
    assert run(strict=True)[("k", 100)] is None and run(span_s=10) == run()


def test_rank_rules(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None), (2, 5.0)], "ts int, x double")
    got = sorted((r.ts, r.x or 0, round(r.v, 6)) for r in d.select("ts", "x", X.rank_normalise("x", ["ts"]).alias("v")).collect())
    assert got == [(1, 0, 0.0), (1, 1.0, -1.0), (1, 2.0, 0.0), (1, 2.0, 0.0), (2, 5.0, -1.0)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(S.parse_number(F.lit(x))) for x in ("1 234,5", "1,234.5", "−7", "12.345,67", "abc", "5 %")] == [1234.5, 1234.5, -7.0, 12345.67, None, 5.0]
    assert [one(S.isin_valid(F.lit(x))) for x in ("US0378331005", "US0378331006", "x")] == [True, False, False] and one(S.isin_valid(F.lit(None).cast("string"))) is False
    assert one(S.parse_date_text(F.lit("the 3 maj 2021"))) == dt.date(2021, 5, 3) and one(S.parse_date_text(F.lit("May 3, 2021"))) == dt.date(2021, 5, 3) and one(S.parse_date_text(F.lit("none"))) is None
    assert one(S.finite_or_null(F.lit(float("inf")))) is None and one(S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(S.normalize_text(F.lit("  a \t b \n\n\n c  "))) == "a b\nc"


def test_validation(spark):
    good = bars_of(spark, [1.0, 2.0])
    bad = good.withColumn("close", F.lit(-1.0)).union(good.withColumn("asset", F.lit("a b"))).union(good.withColumn("low", F.col("close") + 1))
    ok, wrong = B.split_valid(good.unionByName(bad), B.violation())
    assert ok.count() == 2 and sorted(r.reason for r in wrong.collect()) == ["asset", "asset", "price", "price", "range", "range"]
    with pytest.raises(ValueError):
        B.require_unique(good.union(good), ["asset", "ts"])
    with pytest.raises(ValueError):
        B.validate_selection(good, ["close", "close"])


def test_store_and_readers(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i), a, 86_400, 1.0, 2.0, 1.0, 2.0, 5.0, None, None) for i in range(3) for a in ("AA", "BB")]
    bars = spark.createDataFrame(rows, R.BARS)
    store = str(tmp_path / "store")
    ST.replace(bars, store)
    ST.merge(spark.createDataFrame([(dt.datetime(2024, 1, 2), "AA", 86_400, 1.0, 9.0, 1.0, 9.0, 5.0, None, None)], R.BARS), store)
    got = ST.scan(spark, store, 86_400, "AA").orderBy("ts_utc").collect()
    assert [r.close for r in got] == [2.0, 9.0, 2.0] and ST.scan(spark, store, 86_400).count() == 6
    f = tmp_path / "k.csv"
    f.write_text("open_time,open,high,low,close,volume,close_time,quote_volume,trades,rest\n1704067200000,1,2,0.5,1.5,10,0,15,3,x\n1704067200000000,1,2,0.5,1.5,10,0,15,3,x\n1704070800,1,2,0.5,1.5,10,0,15,3,x\n")
    assert R.read_kline_csv(spark, str(f), F.lit("AA"), 3600).count() == 2
    assert [r.ts_utc.hour for r in R.read_kline_csv(spark, str(f), F.lit("AA"), 3600, "2024-01-01 01:00:00").collect()] == [1]
    assert [r.ts_utc.hour for r in R.read_kline_csv(spark, str(f), F.lit("AA"), 3600, "2024-01-01", "2024-01-01 01:00:00").collect()] == [0]
    (tmp_path / "m.jsonl").write_text('{"kind":"manifest","version":"1","features":["x"]}\n{"x":1.5}\n')
    data, manifest = R.read_matrix(spark, str(tmp_path / "m.jsonl"), "x double")
    assert data.first().x == 1.5 and manifest.first().features == ["x"]
    page = '<html><body><nav>n</nav><pre>a  b &amp; c</pre><table><tr><td>X</td><th> Y z</th></tr></table><a href="u"></a><a href="u"></a></body></html>'
    r = spark.range(1).select(R.html_text(F.lit(page)).alias("t"), R.html_links(F.lit(page)).alias("l"), R.html_cells(F.lit(page)).alias("c")).first()
    assert (r.t, r.l, r.c) == ("a b & c", ["u"], [["X", "Y z"]])


def test_cooldown_and_caps(spark):
    s = spark.createDataFrame([("A", 0, 50.0, 10.0, 20.0), ("A", 10, 90.0, 10.0, 20.0), ("A", 100, -50.0, -30.0, 20.0), ("A", 300, 5.0, 1.0, 20.0), ("A", 301, 90.0, 1.0, None)], "asset string, ts_s long, pred_bps double, fwd_bps double, cost_bps double")
    assert sorted((r.ts_s, r.side, r.net_bps) for r in O.cooldown_trades(s, "asset", hold_s=100).collect()) == [(0, 1, -10.0), (100, -1, 10.0)]
    b = spark.createDataFrame([(1, "a", 0.5, 0.2), (1, "b", 0.1, 0.3), (1, "c", -0.4, 0.1)], "ts int, asset string, w double, cap double")
    got = {r.asset: round(r.weight, 6) for r in O.waterfall_cap(b, "ts", "asset", "w", "cap").collect()}
    assert got == {"a": 0.2, "b": 0.3, "c": -0.1}
    n = {r.asset: round(r.weight, 6) for r in O.net_cap(b, "ts", "asset", "w", 0.1, 0.0).collect()}
    assert abs(sum(n.values())) <= 0.1 + 1e-9
    t = spark.createDataFrame([(1, "a", 0.4, False), (1, "b", 0.3, False), (1, "c", 0.1, False), (1, "d", 0.9, True)], "ts int, asset string, drift double, free boolean")
    assert sorted(r.asset for r in O.turnover_budget(t, "ts", "asset", "drift", "free", 0.5).collect()) == ["a", "c", "d"]


def test_direction_state(spark):
    s = spark.createDataFrame([("m", i, x, 0.1) for i, x in enumerate([0.1, 0.5, 0.9, 0.1, -0.1, -0.5])], "k string, ts int, score double, vol double")
    got = [(r.side, round(r.gross, 3)) for r in O.direction_state(s, "k", "ts").orderBy("ts").collect()]
    assert [g[0] for g in got] == [0, 1, 1, 1, 0, -1] and got[0][1] == 0.2


def test_plans_push_filters_and_prune(spark, tmp_path):
    """A scan of one asset lists its partition alone, and reads the columns asked for."""
    rows = [(dt.datetime(2024, 1, 1), a, 86_400, 1.0, 2.0, 1.0, 2.0, 5.0, None, None) for a in ("AA", "BB")]
    ST.replace(spark.createDataFrame(rows, R.BARS), str(tmp_path / "store"))
    plan = ST.scan(spark, str(tmp_path / "store"), 86_400, "AA").select("close")._jdf.queryExecution().toString()
    assert "(asset#" in plan.split("PartitionFilters")[1] and "quote_volume" not in plan.split("ReadSchema")[1]


def test_matrix_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.5, None), ("B", None, 2)], "asset string, x double, n long")
    R.write_jsonl(rows, str(tmp_path / "m"))
    assert sorted(R.read_jsonl(spark, str(tmp_path / "m"), "asset string, x double, n long").collect()) == sorted(rows.collect())


def test_content_hash_against_plain_hashes(spark):
    """Row hashes chained over the values (nulls skipped), summed, combined and hashed: in any order, and every change shows."""
    rows = [("A", 1, 2.5, "x"), ("A", 1, 2.5, "x"), ("A", 2, None, ""), ("B", None, -1.0, "é"), (None, 3, 0.0, None)]
    schema = "asset string, n long, v double, s string"

    def plain_row(values):
        h = 42
        for v in values:
            if v is not None:
                raw = struct.pack("<q", v) if isinstance(v, int) else struct.pack("<d", v) if isinstance(v, float) else v.encode()
                h = xxhash.xxh64_intdigest(raw, h)
        return h - 2**64 if h >= 2**63 else h

    want = {}
    for k in {r[0] for r in rows}:
        hs = [plain_row(r[1:]) for r in rows if r[0] == k]
        x = 0
        for h in hs:
            x ^= h
        want[k] = (len(hs), hashlib.sha256(f"{len(hs)}:{sum(hs)}:{x}".encode()).hexdigest()[:16])
    run = lambda rs: {r.asset: (r.n, r.hash) for r in Q.content_hash(spark.createDataFrame(rs, schema), ["asset"]).collect()}
    assert run(rows) == want == run(rows[::-1])
    changed = run([*rows[:3], ("B", None, -1.0, "e"), rows[4]])
    assert changed["A"] == want["A"] and changed["B"] != want["B"]
    assert run(rows[1:])["A"] != want["A"] and run([]) == {}


def test_block_bootstrap_against_plain_draws(spark):
    rng = np.random.default_rng(5)
    r, b = rng.normal(0.01, 0.02, 47), rng.normal(0.0, 0.02, 47)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r, b))] + [(99, 1.0, None)]
    draw = lambda it, k: int(hashlib.md5(f"17:{it}:{k}".encode()).hexdigest()[:8], 16) % 47
    deltas = []
    for it in range(40):
        days = [(draw(it, k) + j) % 47 for k in range(5) for j in range(10)][:47]
        sharpe = lambda v: v[days].mean() / v[days].std(ddof=1)
        deltas.append(sharpe(r) - sharpe(b))
    got = E.block_bootstrap(spark.createDataFrame(rows, "ts int, r double, b double"), "ts", "r", "b", 40, 10).first()
    want = [*np.quantile(deltas, [0.05, 0.5, 0.95]), np.mean(np.array(deltas) > 0)]
    assert got.iterations == 40 and np.allclose([got.p05, got.p50, got.p95, got.positive], want, atol=1e-6)


def test_fit_trees_learns_a_step(spark):
    """A step of two features is learned to its levels, missing features get a prediction, reruns agree."""
    rows = [(i, float(i % 40), float(i % 7), 3.0 * (i % 40 >= 20) - 1.0 * (i % 7 >= 4)) for i in range(560)]
    m = spark.createDataFrame(rows, "id int, a double, b double, y double").repartition(3, "id").cache()
    model = M.fit_trees(m, ["a", "b"], "y", depth=2, rounds=5)
    got = {r.id: r.prediction for r in model(m).collect()}
    assert max(abs(got[i] - y) for i, _, _, y in rows) < 0.05
    again = M.fit_trees(m, ["a", "b"], "y", depth=2, rounds=5)
    assert got == {r.id: r.prediction for r in again(m).collect()}
    missing = spark.createDataFrame([(1, None, 2.0)], "id int, a double, b double")
    assert model(missing).columns == ["id", "a", "b", "prediction"] and model(missing).first().prediction is not None


def test_notices(spark):
    page = """<html><body><pre class="txtPre">Short name in text. ISIN code: US0378331005. US0378331006.
      <table><tr><td>Short Name</td><td>ABC B</td><td>Order book ID:</td><td>12345, (678) x9</td></tr><tr><td>Short code</td><td></td></tr>
      <tr><td>odd</td></tr><tr><td>First day of trading</td><td>to come</td></tr></table>
      Trading will commence soon. Shares are admitted to trading on or about 12 shares 2024, that is May 3, 2024. The last day of trading was 31/12/2023 &amp; no more.</pre>Short</body></html>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>last day of trading: 31 February 2024</p>")], "id int, html string")
    got = {r.id: tuple(r)[2:] for r in R.notices(rows, "html").collect()}
    assert got[1] == (["ABC B"], ["US0378331005"], ["12345", "678"], dt.date(2024, 5, 3), dt.date(2023, 12, 31))
    assert got[2] == got[3] == got[4] == ([], [], [], None, None)
    kinds = [S.classify_text(F.lit(x), R.NOTICE_KINDS) for x in ("Delisting of A", "Trading halt lifted: resumption of trading", "Listing of B", "C")]
    assert list(spark.range(1).select(*[k.alias(str(i)) for i, k in enumerate(kinds)]).first()) == ["delisting", "resumption", "listing", "other"]


def test_recent_sorts_in_the_database(spark):
    url = "jdbc:derby:memory:operational;create=true"
    rows = spark.createDataFrame([(i, i // 2, f"r{i}") for i in range(50)], "id long, ts long, name string")
    rows.write.jdbc(url, "runs")
    got = R.recent(spark, url, "runs", "ts", "id", 5)
    assert sorted((r.ts, r.id) for r in got.collect()) == [(22, 45), (23, 46), (23, 47), (24, 48), (24, 49)]
    assert R.recent(spark, url, "runs", "ts", "id", 500).count() == 50


def test_upper_median_of_large_and_small_keys(spark):
    rng = np.random.default_rng(8)
    values = {"hot": rng.normal(size=5_001).round(1).tolist(), "even": rng.normal(size=4_000).tolist(), "ties": [2.0] * 3_000 + [1.0] * 3_000, "two": [5.0, 3.0], "one": [7.0], None: [4.0, 1.0, 9.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    got = {r.k: (r.median, r.n) for r in A.upper_median(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", 2).collect()}
    assert got == {k: (sorted(vs)[len(vs) // 2] if len(vs) >= 2 else None, len(vs)) for k, vs in values.items()}


def test_position_fold_against_plain_fold(spark):
    """Adds, reductions, crossings and closings over many spans, null keys, fills without quantity."""
    rng = np.random.default_rng(4)
    rows = [(k, i // 7, i, float(rng.choice([-3, -2, -1, 1, 2, 3])), float(rng.uniform(1, 9))) for k in ("A", "B", None) for i in range(400)]
    rows += [("C", 0, 0, 2.0, 5.0), ("C", 1, 1, -2.0, 6.0), ("D", 0, 0, 0.3, 2.0), ("D", 0, 1, -0.1, 7.0), ("D", 3, 2, -0.2, 7.0), ("D", 4, 3, -0.5, 4.0), ("A", 9, 65, None, 1.0)]
    want = {}
    for k, _, _, f, px in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0] or "", r[2])):
        q, p = want.get(k, (0.0, 0.0))
        n = q + f
        if abs(n) < 1e-12:
            want[k] = (0.0, 0.0)
        elif abs(q) < 1e-12 or (q > 0) == (f > 0):
            want[k] = (n, (q * p + f * px) / n)
        else:
            want[k] = (n, px if (n > 0) != (q > 0) else p)
    d = spark.createDataFrame(rows, "k string, day int, i int, q double, px double").repartition(5)
    got = {r.k: (r.qty, r.avg_price) for r in A.position_fold(d, ["k"], ["i"], "q", "px", span=F.col("day")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
