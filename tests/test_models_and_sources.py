"""Models that carry their cutoff, insider reports, keyset reads, closed positions, calendars by key."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import aggregates as A
from tickloom.operators import artefacts as MA
from tickloom.operators import models as M
from tickloom.sources import readers as R


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b = float(rng.integers(0, 40)), float(rng.normal())
        y = 3.0 * (a >= 20) + 0.5 * b + float(rng.normal(scale=0.1)) + (500.0 if i % 301 == 7 else 0.0)
        rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), a, b, y, 0.5 + (i % 4)))
    return spark.createDataFrame(rows, "id int, day date, a double, b double, y double, risk double").cache()


CUT = "2020-07-31"


def fit(df, **options):
    return MA.fit_tree_model(df, ["a", "b"], "y", "day", CUT, order=["day", "id"], **{"seeds": (1, 2), "depth": 2, "rounds": 4, **options})


def test_rows_after_the_cutoff_are_never_used(spark, matrix):
    """The same model whatever later rows hold, and whatever files the rows come in; the winsorised label is that of the rows used."""
    late = F.col("day") > F.lit(CUT).cast("date")
    other = matrix.withColumns({"y": F.when(late, -1e6).otherwise(F.col("y")), "a": F.when(late, -7.0).otherwise(F.col("a"))}).repartition(5)
    model = fit(matrix, clip_quantile=0.02)
    assert fit(other, clip_quantile=0.02).to_json() == model.to_json() == fit(matrix.where(~late), clip_quantile=0.02).to_json()
    used = [r.y for r in matrix.where(~late).collect()]
    assert model.rows == len(used) and np.allclose(model.clip, np.quantile(used, [0.02, 0.98])) and model.trained_through == CUT
    assert fit(matrix, clip_quantile=0.0).to_json() != model.to_json()
    with pytest.raises(ValueError, match="no rows"):
        MA.fit_tree_model(matrix, ["a", "b"], "y", "day", "2019-01-01", order=["id"])


def test_a_model_is_the_mean_of_its_seeds(spark, matrix):
    """Trees set down from MLlib equal MLlib's own predictions, averaged over the seeds; the scale is their spread."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = fit(matrix)
    rows = matrix.where(F.col("day") <= F.lit(CUT).cast("date"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows.repartitionByRange(1, "day", "id").sortWithinPartitions("day", "id"))
    want = {}
    for seed in (1, 2):
        one = GBTRegressor(featuresCol="x", labelCol="y", maxDepth=2, maxIter=4, seed=seed, subsamplingRate=0.8).fit(data)
        for r in one.transform(data).collect():
            want[r.id] = want.get(r.id, 0.0) + r.prediction / 2
    got = {r.id: r.score for r in M.score_trees(rows, ["a", "b"], json.dumps(model.trees)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)
    assert math.isclose(model.score_scale, float(np.std(list(want.values()))), rel_tol=1e-9)
    later = MA.score(matrix.where(F.col("day") > F.lit(CUT).cast("date")), model, "day").withColumn("d", MA.direction_score("score", model))
    assert all(r.d == max(-1.0, min(1.0, r.score / model.score_scale)) and r.model_id == model.id for r in later.collect()) and later.count() > 100


TREES = [{"split_feature": 0, "threshold": 20.0, "default_left": False, "left_child": {"leaf_value": -1.0}, "right_child": {"leaf_value": 2.0}}]


def test_scoring_refuses_days_the_model_has_learned_from(spark, matrix, tmp_path):
    model = MA.Model("hybrid", ["a", "b"], CUT, "return_per_risk", TREES, [0.1, -0.2, 0.3], 0.25, slope=0.5, offset=0.01)
    MA.save(spark, model, str(tmp_path / "m"))
    assert MA.load(spark, str(tmp_path / "m")) == model
    later = matrix.where(F.col("day") > F.lit(CUT).cast("date"))
    for r in MA.score(later.withColumn("score", F.lit("before")), model, "day", risk="risk").collect():
        raw = 0.25 * (-1.0 if r.a <= 20 else 2.0) + 0.75 * (0.1 * r.a - 0.2 * r.b + 0.3)
        assert math.isclose(r.score, 0.01 + 0.5 * raw * r.risk, rel_tol=1e-12)
    for rows in (matrix, matrix.where(F.col("day") == F.lit(CUT).cast("date")), later.limit(3).withColumn("day", F.lit(None).cast("date"))):
        with pytest.raises(Exception, match="cannot score"):
            MA.score(rows, model, "day", risk="risk").collect()
    with pytest.raises(Exception, match="cannot score"):
        MA.score(matrix, MA.Model("ridge", ["a"], CUT, weights=[1.0, 0.0]), "day").agg(F.sum("score")).collect()
    assert MA.score(matrix.limit(0), model, "day", risk="risk").count() == 0
    rank = MA.Model("ridge", ["a"], CUT, "relative_rank", weights=[2.0, 1.0], reward_scale=3.0)
    assert all(r.score == 3.0 * (2.0 * r.a + 1.0) for r in MA.score(later, rank, "day").collect())


@pytest.mark.parametrize("wrong", [{"family": "forest"}, {"reward": "luck"}, {"trees": []}, {"weights": [1.0]}, {"slope": math.nan}, {"tree_weight": 1.5}])
def test_models_that_are_not_whole(wrong):
    with pytest.raises(ValueError):
        MA.Model(**{"family": "hybrid", "features": ["a"], "trained_through": CUT, "trees": TREES, "weights": [1.0, 0.0], **wrong})
    with pytest.raises(ValueError):
        MA.score(None, MA.Model("ridge", ["a"], CUT, "return_per_risk", weights=[1.0, 0.0]), "day")
    with pytest.raises(ValueError):
        MA.direction_score("score", MA.Model("ridge", ["a"], CUT, weights=[1.0, 0.0], score_scale=0.0))


def test_hybrid_fits_trees_and_ridge_of_the_same_rows(matrix):
    late = F.col("day") > F.lit(CUT).cast("date")
    run = lambda df: MA.fit_hybrid_model(df, ["a", "b"], "y", "day", CUT, order=["day", "id"], seeds=(1,), depth=1, rounds=2)
    model = run(matrix)
    assert model.family == "hybrid" and len(model.weights) == 3 and model == run(matrix.withColumn("y", F.when(late, 9e9).otherwise(F.col("y"))))


def report(**values):
    base = {h: "" for h in R.PDMR} | {"Publication date": "03/05/2021 09:10:11", "Transaction date": "1/5/2021 00:00:00", "Issuer": "A AB"}
    return base | values


def write(path, rows, headers=tuple(R.PDMR), bom=""):
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ';"\n') else v
    path.write_bytes((bom + "\r\n".join([";".join(headers)] + [";".join(quote(r.get(h, "x")) for h in headers) for r in rows]) + "\r\n").encode("utf-16-le"))


def test_insider_reports(spark, tmp_path):
    """A byte-order mark, columns in another order and beside others, quotes, spaces in numbers, blanks, lines of other ends."""
    f = tmp_path / "a.csv"
    odd = ["Extra", *reversed(R.PDMR), "More"]
    write(f, [report(**{"Volume": "1 234\xa0567,5", "Price": " 12,5 ", "Closely associated": "JA", "Amendment": "no", "Details of amendment": 'was; "old"\nnew', "ISIN": " SE0000108656 ", "Status": "Current "}), report(Volume="-3")], odd, bom="﻿")
    one, two = sorted(R.read_pdmr(spark, str(f)).collect(), key=lambda r: r.volume)[::-1]
    assert len(one) == 23 and (one.publication_date, one.publication_time, one.transaction_date) == (dt.date(2021, 5, 3), "09:10:11", dt.date(2021, 5, 1))
    assert (one.volume, one.price, one.closely_associated, one.amendment, one.amendment_details, one.isin, one.status) == (1234567.5, 12.5, True, False, 'was; "old"\nnew', "SE0000108656", "Current")
    assert (two.volume, two.price, two.isin, two.amendment_details, two.venue) == (-3.0, None, None, None, "")
    g = tmp_path / "b.csv"
    write(g, [report()], [h for h in R.PDMR if h != "LEI-code"])
    with pytest.raises(ValueError, match="LEI-code"):
        R.read_pdmr(spark, str(g))
    for bad in ({"Volume": "many"}, {"Transaction date": "2021-05-01"}, {"Publication date": "31/02/2021 00:00:00"}, {"Price": "1e999"}):
        write(g, [report(**bad)])
        with pytest.raises(Exception, match="not a"):
            R.read_pdmr(spark, str(g)).collect()


def test_keyset_reads_by_the_databases_bounds(spark):
    url = "jdbc:derby:memory:keyset;create=true"
    spark.createDataFrame([(i * 7 - 50, f"r{i}") for i in range(100)] + [(None, "none")], "id long, name string").write.jdbc(url, "log")
    rows = R.read_keyset(spark, url, "log", "id", 4)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.rdd.getNumPartitions() == 4 and sum(r["count"] for r in sizes) == 101 and max(r["count"] for r in sizes) <= 27
    assert {(r.id, r.name) for r in rows.collect()} == {(i * 7 - 50, f"r{i}") for i in range(100)} | {(None, "none")}
    spark.createDataFrame([], "id long, name string").write.jdbc(url, "nothing")
    spark.createDataFrame([(3, "one")], "id long, name string").write.jdbc(url, "single")
    assert R.read_keyset(spark, url, "nothing", "id", 4).count() == 0 and R.read_keyset(spark, url, "single", "id", 4).count() == 1


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_positions_in_one_pass_and_by_spans(spark, fold_rows):
    """Both ways against a plain fold: adds, reductions, crossings and closings over many spans, null keys, fills without quantity."""
    rng = np.random.default_rng(4)
    rows = [(k, i // 7, i, float(rng.choice([-3, -2, -1, 1, 2, 3])), float(rng.uniform(1, 9))) for k in ("A", "B", None) for i in range(300)] + [("A", 9, 65, None, 1.0)]
    want = {}
    for k, _, _, f, px in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0] or "", r[2])):
        q, p = want.get(k, (0.0, 0.0))
        n = q + f
        want[k] = (0.0, 0.0) if n == 0 else (n, (q * p + f * px) / n) if q == 0 or (q > 0) == (f > 0) else (n, px if (n > 0) != (q > 0) else p)
    d = spark.createDataFrame(rows, "k string, day int, i int, q double, px double").repartition(5)
    got = {r.k: (r.qty, r.avg_price) for r in A.position_fold(d, ["k"], ["i"], "q", "px", span=F.col("day"), fold_rows=fold_rows).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_a_position_of_decimals_closes_exactly(spark, fold_rows):
    fills = [("x", 0, 0, 100000.1, 5.0), ("x", 0, 1, 200000.2, 6.0), ("x", 1, 2, -300000.3, 7.0), ("x", 1, 3, 5.0, 8.0), ("y", 0, 0, 0.1, 1.0), ("y", 0, 1, 0.2, 1.0), ("y", 1, 2, -0.3, 1.0)]
    d = spark.createDataFrame(fills, "k string, day int, i int, q double, px double").repartition(3)
    assert {r.k: (r.qty, r.avg_price) for r in A.position_fold(d, ["k"], ["i"], "q", "px", span=F.col("day"), fold_rows=fold_rows).collect()} == {"x": (5.0, 8.0), "y": (0.0, 0.0)}


def test_zero_filled_days_by_key(spark):
    day = lambda n: dt.date(2024, 2, n)
    d = spark.createDataFrame([("a", day(1), 1.0), ("a", day(4), 2.0), ("a", day(4), 3.0), (None, day(9), 4.0), ("b", None, 5.0), ("c", day(2), None)], "k string, d date, v double")
    got = sorted(((r.k or "", r.day.day, r.total) for r in A.zero_filled_days(d, "d", F.sum("v"), ["k"]).collect()))
    assert got == [("", 9, 4.0), ("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 5.0), ("c", 2, 0.0)]
    assert [(r.day.day, r.total) for r in A.zero_filled_days(d.where("k = 'a'"), "d", F.sum("v")).orderBy("day").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, 5.0)]
