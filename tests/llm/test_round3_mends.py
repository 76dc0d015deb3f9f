"""Times inside a second, labels of any type, long training texts, hot terms and addresses: against plain computations."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import pivot_index, quality, queries, sanitise, url_filter

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("salted, keys", [(50_000, 100_000), (3, 100_000), (3, 0)])
def test_captures_and_changes_inside_one_second(spark, monkeypatch, salted, keys):
    """Changes and captures microseconds apart, and at the same one: entries count from their start on, removals win."""
    monkeypatch.setattr(url_filter, "SALTED", salted)
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", keys)
    rng = np.random.default_rng(salted)
    base = 1_000_000_000
    entries = [(str(rng.choice(["block", "allow"], p=[0.7, 0.3])), "host", f"h{rng.integers(3)}.org", str(rng.choice(["add", "remove"])), base + int(rng.integers(0, 40)) * 37_000) for _ in range(60)]
    entries += [("block", "host", "late.org", "add", base + 400_000)]
    captures = [(i, f"http://h{i % 3}.org/", base + int(rng.integers(0, 50)) * 37_000 + int(rng.integers(-1, 2))) for i in range(150)]
    captures += [(1_000, "http://late.org/", base + 100_000), (1_001, "http://late.org/", base + 399_999), (1_002, "http://late.org/", base + 400_000)]
    p = spark.createDataFrame(captures, "page_id long, url string, us long").select("page_id", "url", F.timestamp_micros("us").alias("fetched_at"))
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, us long").withColumn("at", F.timestamp_micros("us"))
    got = {r.page_id: (r.blocked, r.n_active, r.since) for r in url_filter.evaluate_captures(p, e).withColumn("since", F.unix_micros("blocked_since")).collect()}
    for page, url, at in captures:
        host, active = url.split("/")[2], {}
        for which in ("block", "allow"):
            since = None
            times = sorted({t for lst, _, key, _, t in entries if lst == which and key == host and t <= at})
            for t in times:
                actions = {a for lst, _, key, a, u in entries if (lst, key, u) == (which, host, t)}
                since = None if "remove" in actions else t if since is None else since
            if since is not None:
                active[which] = since
        blocked = "block" in active and "allow" not in active
        assert got[page] == (blocked, len(active), active["block"] if blocked else None), (page, at)
    assert [got[i][0] for i in (1_000, 1_001, 1_002)] == [False, False, True]


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "decimal(9,2)"])
def test_pivot_index_with_labels_of_any_type(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    x = np.concatenate([x, x[:20] + rng.normal(scale=0.01, size=(20, 8))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(99, x[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    label = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(frame.withColumn("label", label).drop("n")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = (np.arange(60) % 2)[:, None] == (np.arange(60) % 2)[None, :]
    want = ((unit @ unit.T >= 0.93) & same).sum(axis=1) - 1
    assert got == {i: int(n) for i, n in enumerate(want)} | {99: 0} and want.sum() >= 40


def test_nearest_points_in_strips(monkeypatch):
    """The same numbers as a full sort, ties by the smaller number, whatever the strip."""
    rng = np.random.default_rng(6)
    x, points = rng.normal(size=(50, 4)), np.repeat(rng.normal(size=(30, 4)), 2, 0)
    want = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :12]
    for strip in (1, 700, 1 << 20):
        monkeypatch.setattr(pivot_index, "STRIP", strip)
        got = pivot_index.nearest_points(x, points, 12)
        assert [sorted(g) for g in got.tolist()] == [sorted(w) for w in want.tolist()] and (np.diff(np.take_along_axis(x @ points.T, got, 1), axis=1) <= 1e-12).all()
    assert pivot_index.nearest_points(x, points[:3], 12).shape == (50, 3)


def test_one_huge_training_text_leaves_the_others(spark):
    """A labelled text larger than the bound is passed over; where none fits, fitting raises."""
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        words, good = rng.choice(plain, 100).tolist(), i % 3 != 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    first = spark.range(240).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("id"), "id").first().id
    rows[first] = (first, "plain words " * 400_000)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality.fit_quality(docs, labels, train_passages=2_000)
    got = {r.doc_id: r.quality for r in quality.score_quality(docs, net).collect()}
    wrong = [i for i in range(240) if i != first and (got[i] >= 0.3) != (i % 3 != 0)]
    assert len(wrong) <= 3
    with pytest.raises(ValueError, match="at most"):
        quality.fit_quality(docs, labels, train_passages=0)


@pytest.mark.parametrize("share, most", [(1e-3, 200_000), (0.05, 200_000), (0.0, 1)])
def test_hot_terms_and_addresses(spark, monkeypatch, share, most):
    """An address and a word of all affected documents beside rare ones: hot values broadcast, some, or none; the same terms as by plain counts."""
    monkeypatch.setattr(sanitise, "HOT_SHARE", share)
    monkeypatch.setattr(sanitise, "BROADCAST_VALUES", most)
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    texts = []
    for i in range(150):
        own = " ".join(rng.choice(words, 12).tolist())
        # The code name goes with the popular address; the harmless rare word stands without any.
        mail = "the office@firm.org zebra" if i < 60 else f"the person{i}@home.net nickname{chr(97 + i % 26)}{chr(97 + i // 26)}x" if i < 80 else "the harmless" if i < 84 else "the"
        texts.append((i, f"{own} {mail}"))
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    _, dirty = sanitise.found_spans(docs)
    got = {r.doc_id: {s.value for s in r.spans if s.kind == 4} for r in dirty.collect()}
    runs = {i: {w for w in "".join(c if c.isalpha() else " " for c in t).split()} for i, t in texts}
    holds = collections.defaultdict(set)
    for i, t in texts:
        for w in t.split():
            if "@" in w:
                holds[w].add(i)
    df, n = collections.Counter(w for r in runs.values() for w in r), len(texts) + 1
    want = {i: set() for docs_of in holds.values() for i in docs_of}
    for docs_of in holds.values():
        ic = -np.log((len(docs_of) + 1) / n)
        for w in {w for i in docs_of for w in runs[i]}:
            both = sum(w in runs[i] for i in docs_of)
            if ic > 0 and np.log(both / len(docs_of) / ((df[w] + 1) / n)) >= ic / 1.5 - 1e-12:
                for i in docs_of:
                    want[i] |= {w} & runs[i]
    assert got == want
    assert all("zebra" in got[i] and "the" not in got[i] for i in range(60)) and all("harmless" not in v for v in got.values())
    assert all(any(w.startswith("nickname") for w in got[i]) for i in range(60, 80))


def test_staging_scope_deletes_what_was_staged_inside(spark, tmp_path):
    import os

    from tickloom.llm import common, minhash

    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, None)], DOCS)
    kept = common.stage(docs, "outside")
    with common.staging(spark):
        with common.staging(spark):
            inner = common.stage(docs, "inside")
        outer = common.stage(docs, "inside")
        found = minhash.near_duplicate_classes(docs).count()
        assert not os.path.exists(inner.staged_at) and os.path.exists(outer.staged_at)
    assert found == 3 and kept.count() == 3 and not os.path.exists(outer.staged_at) and not common._OPEN
    with pytest.raises(RuntimeError), common.staging(spark):
        lost = common.stage(docs, "inside")
        raise RuntimeError
    assert not os.path.exists(lost.staged_at)


@pytest.mark.parametrize("pivots", [16_384, 65_536])
def test_recall_and_work_with_very_many_pivots(pivots):
    """Planted pairs at the threshold share enough of their nearest reference points, and random vectors meet ever less often."""
    rng = np.random.default_rng(31)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    points, a = unit(rng.normal(size=(pivots, 48))), unit(rng.normal(size=(500, 48)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    near = [pivot_index.nearest_points(v, points, 12) for v in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * side)]
    need = pivot_index.shared_of(pivots)
    shared = np.array([len(np.intersect1d(u, v)) for u, v in zip(*near)])
    assert (shared >= need).mean() >= 0.95
    listed = np.bincount(near[0].ravel(), minlength=pivots)
    met = (listed * (listed - 1)).sum() / (len(a) * (len(a) - 1))
    assert met < 250 / pivots


def test_toxicity_stage_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double")
    out = corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.001")
    assert out.count() == 0 and out.columns == docs.columns


SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_near_duplicate_query_against_all_pairs(spark):
    """The query over the whole small table: classes as by weighted Jaccard similarity over all pairs of texts."""
    from tests.llm.test_llm import brute_groups

    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    groups = brute_groups([r.text for r in docs], len(docs))
    got = {r.doc_id: (r.class_id, r.kept) for r in queries.QUERIES["op8_minhash"](spark, SMALL).collect()}
    assert got == {r.doc_id: (docs[g].doc_id, docs[g].doc_id == r.doc_id) for r, g in zip(docs, groups)}
    assert sum(not kept for _, kept in got.values()) > 5


@pytest.mark.parametrize("name, column, missed, false", [("op9_quality", "quality", 0.15, 0.03), ("op10_toxicity", "toxic", 0.15, 0.03)])
def test_score_queries_on_held_out_labels(spark, name, column, missed, false):
    """Labels that training never saw: few wrong ones of the common class, most of the rare one found."""
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = [(label[r.doc_id], r.predicted) for r in queries.QUERIES[name](spark, LARGE).collect() if r.held_out and label.get(r.doc_id) is not None]
    common = 1 if column == "quality" else 0
    usual, rare = [p for y, p in rows if y == common], [p for y, p in rows if y != common]
    assert len(usual) > 400 and len(rare) > 80
    assert np.mean([p != common for p in usual]) <= false and np.mean([p == common for p in rare]) <= missed
