"""Hot keys and half-done writes: quantiles by brackets, as-of joins by spans, the bar store, against plain computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import joins as J
from tickloom.operators import quantiles as QU
from tickloom.sources import readers as R
from tickloom.sources import store as ST

FRACTIONS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}


@pytest.mark.parametrize("small, most", [(100_000, 500_000), (100, 500_000), (1, 40)])
def test_quantiles_against_numpy(spark, small, most):
    """Plain, by brackets, and by brackets cut by histograms; ties, infinities, null keys and values, ranges wider than any number."""
    rng = np.random.default_rng(1)
    values = {"hot": rng.normal(size=20_000).tolist(), "ties": [1.0] * 8_000 + [2.0] * 7_000 + [3.0] * 3, "wide": [*(10.0 ** rng.uniform(-300, 300, size=12_000)).tolist(), -1.7e308, 1.7e308], "small": [5.0, 1.0, 9.0], "one": [4.0], None: [2.0, 3.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("hot", None)] + [("far", v) for v in [math.inf] * 3 + [1.0] * 9 + [-math.inf] * 200]
    d = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r for r in QU.quantiles(d, ["k"], "v", FRACTIONS, small=small, most_values=most).collect()}
    assert set(got) == {*values, "none", "far"} and tuple(got["none"])[1:] == (0, *[None] * 6)
    for k, vs in values.items():
        assert got[k].n == len(vs) and np.allclose([got[k][f] for f in FRACTIONS], np.quantile(vs, list(FRACTIONS.values())), rtol=1e-12, atol=0)
    assert [got["far"][f] for f in FRACTIONS] == [-math.inf] * 3 + [-math.inf if 0.9 * 211 <= 199 else 1.0] + [math.inf] * 2
    whole = QU.quantiles(d.where("k = 'hot'"), [], "v", FRACTIONS, small=small, most_values=most).collect()
    assert len(whole) == 1 and np.allclose(list(whole[0])[1:], np.quantile(values["hot"], list(FRACTIONS.values())))
    assert [tuple(r) for r in QU.quantiles(d.limit(0), [], "v", FRACTIONS, small=small).collect()] == [(0, *[None] * 6)] and QU.quantiles(d.limit(0), ["k"], "v", FRACTIONS).count() == 0


def test_a_large_key_is_never_gathered(spark, monkeypatch):
    """With a large key the exact percentile sees only the rows of small keys."""
    d = spark.range(5_000).select(F.when(F.col("id") < 4_990, "hot").otherwise("small").alias("k"), F.col("id").cast("double").alias("v"))
    plan = QU.quantiles(d, ["k"], "v", {"m": 0.5}, small=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("percentile(") < plan.index("isnull(q_large") < plan.rindex("Range")
    assert {r.k: (r.n, r.m) for r in QU.quantiles(d, ["k"], "v", {"m": 0.5}, small=100).collect()} == {"hot": (4_990, 2_494.5), "small": (10, 4_994.5)}


@pytest.mark.parametrize("span_rows", [10**6, 50])
@pytest.mark.parametrize("strict, tolerance", [(False, None), (True, None), (False, 40)])
def test_asof_of_a_hot_key_against_plain_search(spark, span_rows, strict, tolerance):
    """A key with bursts and ties at span bounds, small keys, null keys and times on both sides; in one window and in spans."""
    rng = np.random.default_rng(7)
    time = lambda k: int(rng.choice([rng.integers(0, 3_000), 1_500 + rng.integers(0, 5)])) if k == "hot" else int(rng.integers(0, 90))
    make = lambda n: [(k, time(k), i) for i, k in enumerate(rng.choice(["hot", "a", "b"], n, p=[0.9, 0.05, 0.05]).tolist())]
    left, right = make(500) + [(None, 5, 900), ("hot", None, 901)], make(400) + [(None, 1, 902), ("hot", None, 903)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, s long, v long").repartition(3)
    us = F.col("s") * 1_000_000
    got = {r.v: r.hit and r.hit.v for r in J.asof_join(frame(left), frame(right), ["k"], us, us, "hit", ["v"], strict=strict, tolerance_s=tolerance, span_rows=span_rows).collect()}
    for k, s, v in left:
        before = [(t, x) for key, t, x in right if k and s is not None and key == k and t is not None and (t < s if strict else t <= s)]
        best = max(before, default=None)
        assert got[v] == (best[1] if best and (tolerance is None or s - best[0] <= tolerance) else None)
    assert len(got) == len(left)


def test_spans_are_of_equal_depth(spark):
    """Nine tenths of a key's rows in one second: no span holds much more than its share; keys below the limit have none."""
    rng = np.random.default_rng(3)
    t = np.where(rng.random(40_000) < 0.9, 10**9 + rng.integers(0, 10**6, 40_000), rng.integers(0, 10**12, 40_000))
    times = spark.createDataFrame([("hot", int(x)) for x in t] + [("cold", 1)], "k string, j_t long")
    bounds = J.time_spans(times, ["k"], 1_000, 64)
    sizes = {(r.k, r.j_span): r["count"] for r in J._in_spans(times, bounds, ["k"]).groupBy("k", "j_span").count().collect()}
    assert len(sizes) == 65 and sizes["cold", 0] == 1 and max(sizes.values()) < 1.2 * 40_000 / 64
    assert J.time_spans(times, ["k"], 50_000) is None


def bar(day, asset, close):
    return (dt.datetime(2024, 1, day), asset, 86_400, 1.0, 2.0, 1.0, close, 5.0, None, None)


def closes(spark, path, **options):
    return {(r.asset, r.ts_utc.day): r.close for r in ST.scan(spark, path, **options).collect()}


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    """Killed while the data is written, and between data and log: readers see the old version, and the next write goes through."""
    path = str(tmp_path / "store")
    frame = lambda *rows: spark.createDataFrame(list(rows), R.BARS)
    assert closes(spark, path) == {} and ST.latest_version(spark, path) == 0
    assert ST.replace(frame(bar(1, "AA", 1.0), bar(2, "AA", 2.0), bar(1, "BB", 3.0)), path) == 1
    old = {("AA", 1): 1.0, ("AA", 2): 2.0, ("BB", 1): 3.0}
    new = frame(bar(2, "AA", 20.0), bar(3, "AA", 30.0), bar(2, "BB", 40.0), bar(9, "CC", 50.0))
    broken = new.repartition(4, "asset").withColumn("close", F.when(F.col("asset") == "CC", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        ST.merge(broken, path)
    assert closes(spark, path) == old and ST.latest_version(spark, path) == 1

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ST, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            ST.merge(new, path)
    assert closes(spark, path) == old
    assert ST.merge(new, path) == 2
    assert closes(spark, path) == {("AA", 1): 1.0, ("AA", 2): 20.0, ("AA", 3): 30.0, ("BB", 1): 3.0, ("BB", 2): 40.0, ("CC", 9): 50.0}
    assert closes(spark, path, version=1) == old and closes(spark, path, asset="CC", interval_s=86_400) == {("CC", 9): 50.0} and closes(spark, path, interval_s=60) == {}
    # Partitions that a write doesn't touch stay in their folder.
    ST.merge(frame(bar(1, "CC", 7.0)), path)
    assert {r.asset: r.version for r in ST.partitions(spark, path).collect()} == {"AA": 2, "BB": 2, "CC": 3}


def test_a_store_that_moved_on_refuses_the_write(spark, tmp_path):
    path = str(tmp_path / "store")
    ST.replace(spark.createDataFrame([bar(1, "AA", 1.0)], R.BARS), path)
    with pytest.raises(RuntimeError, match="moved on"):
        ST.replace(spark.createDataFrame([bar(1, "AA", 2.0)], R.BARS), path, base=0)
    assert closes(spark, path) == {("AA", 1): 1.0}
