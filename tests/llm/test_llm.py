"""The operators against brute force, the tokenizers library and their stated edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import bpe, common, minhash, mixing, pivot_index, quality, queries, sanitise, token_store, topk, toxicity, url_filter

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"
ODD = [
    "", "  a  b", "aaaaaaaa", "a" * 5001, "<|endoftext|>x<|endoftext|>", "\x1c\x1d q\x85w", "ÉCOLE é é ΣΑΣ ς İi", "日本語テキスト 한국", "😀😀 👨‍👩‍👧 zzz", "it's 'S 're don'T",
    " \n\n  \t x", "<|startoftext|>hi <|ENDOFTEXT|>", " a　b\xa0c", "½²Ⅷ٣", "ﬁ ﷺ", "!!'s''d", "x\x00y​z", "١٢٣ abc̀", "a\n \nb", "one\n two \nthree", " lead", "trail ", "é 가",
]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "clash") for i, t in zip(ids, texts)], DOCS)


@pytest.mark.parametrize("text", ODD)
def test_codecs_equal_the_library(text):
    for path, made in ((BYTE, bpe.codec_of(BYTE)), (WORD, token_store.encoder_of(WORD))):
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        got = np.frombuffer(made.encode([text, "and " + text, text])[0], "<u4").tolist()
        assert got == want
        if path == BYTE:
            assert made.decode(np.array(got, "<u4").tobytes()) == Tokenizer.from_file(path).decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters, n", [("abcdefghijklmnopqrstuvwxyz", 300_000), ("aeinrst", 300_000), ("ab", 50_000), ("a", 50_001), ("éüß日本", 30_000), ("0123456789abcdef", 3_000_000)])
def test_bpe_of_a_very_long_word(letters, n):
    """Unbroken texts, merged apart from the others, equal the library's; 3 MB take seconds."""
    text = "".join(np.random.default_rng(n).choice(list(letters), n))
    want = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert np.array_equal(np.frombuffer(bpe.codec_of(BYTE).encode([text, "short one"])[0], "<u4"), np.array(want))


def test_bpe_digest(spark):
    texts = [*ODD, None, "again again"]
    got = {r.doc_id: r for r in bpe.bpe_digest(docs_of(spark, texts), BYTE).collect()}
    t = Tokenizer.from_file(BYTE)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    made = bpe.bpe_encode(docs_of(spark, ["a b"]), BYTE)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "decoded"] and made.first().decoded == "a b"
    assert bpe.bpe_digest(docs_of(spark, ["x"]).limit(0), BYTE).count() == 0


def test_token_store(spark):
    texts, ids = [*ODD, None, "last one", "twice", "twice"], [*range(len(ODD)), None, 400, 77, 77]
    path = common.new_path(spark, "store")
    token_store.write_tokens(docs_of(spark, texts, ids), path, WORD)
    rows = token_store.read_tokens(spark, path).collect()
    t, start = Tokenizer.from_file(WORD), 0
    for r in sorted(rows, key=lambda r: r.start):
        want = np.array(t.encode(texts[ids.index(r.doc_id)] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += r.n_tokens
    assert len(rows) == len(texts) and min(rows, key=lambda r: r.start).doc_id is None
    assert token_store.read_document(spark, path, 400) == [t.encode("last one", add_special_tokens=False).ids + [2]]
    assert len(token_store.read_document(spark, path, 77)) == 2
    empty = common.new_path(spark, "store")
    token_store.write_tokens(docs_of(spark, ["x"]).limit(0), empty, WORD)
    assert token_store.read_tokens(spark, empty).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist(), 0, "s") for i, v in enumerate(x)]
    rows += [(300, None, 0, "s"), (400, [float("nan")] * 8, 0, "s"), (500, [1.0] * 7 + [None], 0, "s"), (None, [1.0] * 8, 0, "s"), (600, [], 0, "s"), rows[5], (700, [1.0] * 3, 0, "s")]
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, query_block=2, shard=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    assert set(got) == {0, 100, 200}
    for q in got:
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(300) if i != q))[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(vectors(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("unit", [1.0, 40.0, 1e5, 2.2e6])
def test_top_k_of_wide_integers(spark, monkeypatch, unit):
    """Narrow and wide integer types, strips smaller than a block, sums beyond 2**53."""
    monkeypatch.setattr(topk, "STRIP", 3)
    x = [[unit], [-unit], [unit / 3], [-unit / 7], [0.0], [unit], [-32.0], [31.999]]
    rows = [(i, v, 0, "s") for i, v in enumerate(x)]
    ints = [math.floor(1024 * float(np.float32(v[0]))) for v in x]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") >= 0, k=3).collect()}
    assert len(got) == 24
    for q, a in enumerate(ints):
        best = sorted((-a * b, i) for i, b in enumerate(ints) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]


def test_pivot_index_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:60] + rng.normal(scale=0.08, size=(60, 16)), np.repeat(base[:1], 40, 0)]).astype(np.float32)
    label = [int(i % 3 == 0) if i < 120 else int((i - 120) % 3 == 0) if i < 180 else 1 for i in range(220)]
    rows = [(i, v.tolist(), lab, "s") for i, (v, lab) in enumerate(zip(x, label))]
    rows += [(900, x[0].tolist(), None, "s"), (901, [0.0] * 16, 1, "s"), (902, None, 1, "s"), (903, [float("inf")] * 16, 1, "s"), (None, x[0].tolist(), 1, "s")]
    got = {r.vec_id: r for r in pivot_index.near_duplicates(vectors(spark, rows), block=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None]) & ~np.eye(220, dtype=bool)
    found = sum(got[i].n_links for i in range(220))
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(220))
    for i in (900, 901, 902, 903):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True) and len(got) == len(rows)
    assert pivot_index.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_groups(texts, n):
    """The least place of each text's class, by comparing all pairs; ``n`` is the number of rows that idf counts."""
    value, counts, each = minhash.shingle_counts(*minhash.word_hashes([t or "" for t in texts]))
    df = collections.Counter(value.tolist())
    weight = counts * np.array([np.clip(1 + math.log((n + 1) / (df[v] + 1)) / math.log(n + 1), 1, 2) for v in value.tolist()])
    parts = list(zip(np.split(value, np.cumsum(each)[:-1]), np.split(weight, np.cumsum(each)[:-1])))
    group = list(range(len(parts)))
    for i in range(len(parts)):
        for j in range(i):
            if minhash.weighted_jaccard(parts[i], parts[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        t = rng.choice(words, 80).tolist()
        texts.append(" ".join(t))
        for k in (1, 2, 4):
            e = list(t)
            for j in rng.integers(0, 80, k):
                e[j] = "edited"
            texts.append(" ".join(e))
    base = rng.choice(words, 120).tolist()
    for i in range(60):  # a large bucket
        e = list(base)
        for j in rng.integers(0, 120, 2):
            e[j] = f"x{i}"
        texts.append(" ".join(e))
    texts += [texts[0].upper(), "  " + texts[0], "", "", None, "one", "one", "one two", " ".join(words * 20)]
    rows = docs_of(spark, texts, [*range(len(texts) - 1), None])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(rows, group=8).collect()}
    group = brute_groups(texts[:-1], len(texts))
    assert [got[i] for i in range(len(group))] == group and got[None] is None
    kept = {r.doc_id for r in minhash.near_duplicate_kept(rows).collect()}
    assert kept == {i for i in range(len(group)) if group[i] == i} | {None}
    assert minhash.near_duplicate_classes(rows.limit(0)).count() == 0


def test_near_duplicates_of_a_large_bucket_of_long_texts(spark):
    """3,000 different near copies, some of them long, and two rows of one id with different texts: split leaders and byte-bounded tiles lose no link."""
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(900)]
    base, long, twin = (rng.choice(words, n).tolist() for n in (150, 6_000, 50))
    texts = [" ".join([*base[: 20 + i % 5], f"x{i}", *base[21 + i % 5 :]]) for i in range(3_000)]
    texts += [" ".join([*long[:3_000], f"y{i}", *long[3_000:]]) for i in range(40)]
    texts += [" ".join(rng.choice(words, 60)) for _ in range(200)]
    ids = [*range(len(texts)), 5_000, 5_000, 5_001, 6_000]
    texts += [" ".join(rng.choice(words, 50)), " ".join(twin), " ".join([*twin[:-1], "z"]), texts[3_239].upper()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs_of(spark, texts, ids), group=64, group_bytes=50_000).collect()}
    assert all(got[i] == 0 for i in range(3_000)) and all(got[i] == 3_000 for i in range(3_000, 3_040))
    rest = [got[i] for i in range(3_040, 3_240)]
    assert rest == list(range(3_040, 3_240)) and got[5_000] == got[5_001] == 5_000 and got[6_000] == 3_239


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    rng = np.random.default_rng(2)
    parts = ["a.b@c-d.example", "é", "😀 ", "x@y", "x@y.z@w.v", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+49 30 1234567", "+1", " ", "\n", "..", "a@b.c.@x.y", "_d@e.f-", "12 34", "@", "+", "5500005555555559", "9"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)] + ["", None, "a" * 20_000 + "@", "1" * 20_000, ".a" * 3000 + "@b" + ".c" * 5000]
    got = {r.doc_id: r for r in sanitise.span_digest(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        listed = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t, got[i].spans, listed)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_disclosing_terms_and_rewriting(spark):
    texts = [f"the Zorblat person wrote the mail anna@x.example number{i % 7} today" for i in range(4)] + [f"the quick text number {i} about the weather" for i in range(60)]
    rows = docs_of(spark, texts)
    got = {r.doc_id: r for r in sanitise.span_digest(rows).collect()}
    assert got[0].spans.startswith("term:4:11") and "email:34:48" in got[0].spans and got[10].spans == ""
    clean = {r.doc_id: r for r in sanitise.sanitised(rows).collect()}
    assert "anna" not in clean[0].text and "Zorblat" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[10].text == texts[10]
    assert clean[0].ids == "clash" and clean[0].n_chars == len(clean[0].text)
    assert sanitise.span_digest(rows.limit(0)).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "en", ["a", "b", "c", None, "d"][i % 5] if i % 3 else "a", None, "x") for i in range(300)]
    rows += [(1000, None, "en", "a", None, "x"), (1001, "", "en", "z", None, "x"), (7, rows[7][1], "en", rows[7][3], None, "x"), (None, "a\x0bb\xa0c", "en", "a", None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    mixed, pieces = mixing.mix(docs, block=50)
    got = mixed.collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_ = dict.fromkeys(names, 0.0), set(names)
    left = 1.5 * sum(size.values())
    while left > 1e-6 and open_:
        share, total, left = left, sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            goal[s] += share * weight[s] / total
            if goal[s] >= 2 * size[s]:
                left += goal[s] - 2 * size[s]
                goal[s] = 2.0 * size[s]
                open_.discard(s)
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, goal[r.source], abs_tol=1e-3) and 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 1 for s in names)
    assert sum(r.last - r.first for r in pieces.collect()) == sum(taken.values())
    assert sorted(map(str, mixing.mix(docs, block=50)[0].collect())) == sorted(map(str, got))
    assert mixing.mixed_documents(docs, block=50).columns == docs.columns and mixing.mix(docs.limit(0))[0].count() == 0


def test_schedule_against_plain_golden_points(spark):
    """Slots draw from the source in whose interval their golden-ratio point falls; ranks count a source's slots; what is short closes at the end."""
    block, goal, size = 100, [3_150.0, 820.5, 1_999.0, 40.0], [2_000, 900, 1_000, 20]
    goals = spark.createDataFrame([(i + 1, g, s) for i, (g, s) in enumerate(zip(goal, size))], "n long, target double, source_size long")
    got = collections.defaultdict(list)
    for r in mixing.schedule(goals, block).collect():
        got[r.n].append((r.slot, r.rank))
    need = [math.floor(g) // s * math.ceil(s / block) + math.ceil(math.floor(g) % s / block) for g, s in zip(goal, size)]
    bounds = np.round(np.cumsum([0, *goal]) / sum(goal) * 2**32)
    want, count = collections.defaultdict(list), math.ceil(sum(goal) / block)
    for slot in range(count):
        n = int(np.searchsorted(bounds, slot * mixing.GOLDEN % 2**32, "right"))
        if len(want[n]) < need[n - 1]:
            want[n].append((slot, len(want[n])))
    for n, slots in got.items():
        slots.sort(key=lambda x: x[1])
        assert slots[: len(want[n])] == want[n] and [r for _, r in slots] == list(range(need[n - 1])) and all(s >= count for s, _ in slots[len(want[n]) :])
    # Low discrepancy: after any number of slots each source is near its share.
    for n, slots in want.items():
        if goal[n - 1] / size[n - 1] <= 2 and len(slots) < need[n - 1]:
            for i, (slot, rank) in enumerate(slots):
                assert abs(i - slot * goal[n - 1] / sum(goal)) <= 3


def test_classifiers(spark):
    rng = np.random.default_rng(8)
    plain, bad = [f"word{i}" for i in range(300)], ["scoundrel", "nitwit"]
    rows, labels = [], []
    for i in range(400):
        t = rng.choice(plain, 120).tolist()
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for j in range(5):
                t[40 + 3 * j] = bad[j % 2]
        rows.append((i, " ".join(t) if good else " ".join(w.upper() + "!!" for w in t), "en", "s", None, "x"))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None, "en", "s", None, "x"), (901, "", "en", "s", None, "x"), (None, "a b", "en", "s", None, "x")]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i in out if (got[i].toxicity >= 0.5) != (i % 5 == 0)]
    assert len(out) > 60 and len(wrong) <= 1 and got[900].toxic_passages == [] and 0 <= got[900].toxicity < 0.5 and len(got) == len(rows)
    hit = got[0].toxic_passages[0]
    assert hit.first_word >= 40 and hit.last_word <= 52
    net = quality.fit_quality(docs, labels)
    scored = {r.doc_id: r for r in quality.score_quality(docs, net).collect()}
    assert sum((scored[i].quality >= 0.3) != (i % 4 != 0) for i in out) <= 1 and 0 <= scored[901].quality <= 1
    none = labels.limit(0)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).count() == len(rows)
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs, none)).count() == 0


def test_maximal_segments_against_brute_force():
    """All maximal segments: the best one, and again those to its left and to its right."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        s = np.where(rng.random(n) < 0.4, rng.uniform(0.1, 3, n), -0.5)

        def brute(a, b):
            best = max(((s[i:j].sum(), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return [] if best[0] <= 1e-12 else [*brute(a, best[1]), (best[1], best[2] - 1, best[0]), *brute(best[2], b)]

        hot = np.flatnonzero(s > 0)
        got, want = toxicity.maximal_segments(hot.tolist(), s[hot].tolist(), 0.5), brute(0, n)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_extreme_value_fit_and_surprise():
    """Parameters of drawn extremes are found again, the surprise bounds a Poisson tail, and strong documents are told apart."""
    rng = np.random.default_rng(31)
    words = rng.integers(50, 3_000, 40_000).astype(float)
    count = rng.poisson(0.002 * words)
    most = np.array([rng.exponential(1 / 1.4, k).max() if k else 0.0 for k in count])
    rate, scale = toxicity.fit_extremes(most, words)
    assert abs(rate - 1.4) < 0.08 and abs(scale / 0.002 - 1) < 0.1
    model = toxicity.ToxicityModel(np.zeros(0), rate=1.0, scale=1e-3)
    for n, sums in [(1_000, [0.5, 0.2, 0.1]), (200, [4.0]), (5_000, [1.0] * 30), (10, [])]:
        strong, many = toxicity.surprise(model, n, np.array(sums))
        expected = [1e-3 * n * math.exp(-x) for x in sums]
        assert math.isclose(strong, sum(-math.log(e) for e in expected if e < 0.05), abs_tol=1e-9)
        tails = [sum(math.exp(k * math.log(e) - e - math.lgamma(k + 1)) for k in range(r, r + 200)) for r, e in enumerate(expected, 1)]
        assert many <= max([-math.log(t) for t in tails], default=0) + 1e-6
    a, b = (toxicity.surprise(model, 100, np.array([x] * 40))[0] for x in (9.0, 10.0))
    assert b > a > 50


def test_link_against_plain_descent():
    rng = np.random.default_rng(32)
    z = rng.exponential(1, (500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2)))).astype(float)
    slopes, offset = toxicity.fit_link(z, y)
    w = np.array([*slopes, offset])
    x = np.column_stack([z, np.ones(500)])
    used = np.array([slopes[0] > 0, slopes[1] > 0, True])
    assert min(slopes) >= 0 and np.abs((x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.01 * w)[used]).max() < 1e-6


def test_gradients_of_the_net():
    """Every gradient against differences of the loss, and the forward pass against one bag at a time."""
    rng = np.random.default_rng(33)
    texts = ["some plain words here " * 60, "X! Y! 9 " * 40, "", "short", "again words words " * 80]
    x, each = quality.encode_passages(texts)
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0])
    net = quality.MilNet(x.mean(0), x.std(0) + 1e-3)

    def loss():
        s, _ = net.forward(x, each)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + 0.5 * (quality.DECAY * net.p["W"] ** 2).sum() + 0.5e-4 * (net.p["c"] ** 2).sum()

    grads = net.gradients(x, each, y)
    for name, value in net.p.items():
        flat = np.atleast_1d(value).reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            old, step = net.p[name], 1e-5
            up, down = (np.array(old, float).copy().reshape(-1) for _ in range(2))
            up[k] += step
            down[k] -= step
            net.p[name] = up.reshape(np.shape(old))
            high = loss()
            net.p[name] = down.reshape(np.shape(old))
            low = loss()
            net.p[name] = old
            assert math.isclose((high - low) / (2 * step), np.atleast_1d(grads[name]).reshape(-1)[k], rel_tol=1e-3, abs_tol=1e-6), name
    ends = np.cumsum(each)
    alone = [net.forward(x[b - n : b], np.array([n]))[0][0] for b, n in zip(ends, each)]
    assert np.allclose(alone, net.forward(x, each)[0])


def test_words_of_passages_against_plain_counts():
    """Hashed words and pairs: as many buckets hold them as there are kinds, in the passage where a word starts."""
    text = "Alpha beta alpha " * 50
    x, each = quality.encode_passages([text, "beta alpha", text])
    part = x[:, quality.CLASSES + quality.CLASSES**2 : -4]
    assert each.tolist() == [2, 1, 2] and np.array_equal(part[:2], part[3:])
    assert np.allclose(np.sort(part[0][: quality.WORDS])[-3:], 1 / 3, atol=0.02) and np.allclose(part[2][: quality.WORDS].sum(), 1)
    assert (part[2][quality.WORDS :] > 0).sum() == 1 and np.allclose(part[2][quality.WORDS :].sum(), 0.5)


def test_classifiers_of_a_very_long_text(spark):
    """A text of 3 MB is scored whole beside short ones."""
    docs = docs_of(spark, ["plain words " * 250_000, "x", None])
    net = quality.MilNet(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    assert quality.score_quality(docs, net).where("quality between 0 and 1").count() == 3
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS))
    assert toxicity.score_toxicity(docs, model).where("toxicity between 0 and 1").count() == 3


@pytest.mark.parametrize("salted, keys", [(50_000, 100_000), (5, 0)])
def test_url_filter_against_brute_force(spark, monkeypatch, salted, keys):
    """Hosts of 12 labels and paths of 8 steps; also with salted keys, and with listed keys joined by shuffle."""
    monkeypatch.setattr(url_filter, "SALTED", salted)
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", keys)
    rng = np.random.default_rng(9)
    deep = "1.2.3.4.5.6.7.8.9"
    hosts = ["a.example.com", "b.a.example.com", f"{deep}.example.com"]
    pages = [(i, f"https://{hosts[rng.integers(3)]}/p{rng.integers(2)}/q/r/s/t/u/v/w?x#y" if i % 17 else None, 86_400 * 3 * i // 40 + int(rng.integers(50))) for i in range(300)]
    pages += [(301, "not a url", 5), (302, "https://a.example.com", None)]
    entries = [(["block", "allow"][int(rng.random() < 0.3)], *[("host", hosts[rng.integers(3)]), ("domain", ["example.com", hosts[2]][rng.integers(2)]), ("prefix", [f"{hosts[0]}/p0", f"{hosts[1]}/p1/q/r/s/t/u/v/w"][rng.integers(2)])][rng.integers(3)], ["add", "remove"][rng.integers(2)], int(rng.integers(0, 2_000_000))) for _ in range(120)]
    entries += [("block", "host", None, "add", 4), ("block", "host", hosts[0], "other", 4), ("block", "host", hosts[0], "add", None)]
    pages += pages[:3]
    p = spark.createDataFrame(pages, "page_id long, url string, s long").select("page_id", "url", F.timestamp_seconds("s").alias("fetched_at"), F.lit(1).alias("blocked"))
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.page_id: r for r in url_filter.evaluate_captures(p, e).collect()}
    log = collections.defaultdict(dict)
    for lst, kind, key, action, at in entries:
        if key and at is not None and action in ("add", "remove"):
            log[lst, kind, key][at] = "remove" if "remove" in (action, log[lst, kind, key].get(at)) else "add"
    for page, url, at in pages:
        host = re.match(r"https://([^/]+)", url or "")
        active = []
        if host and at is not None:
            h = host[1]
            keys = [("host", h)] + [("domain", h.split(".", k)[-1]) for k in range(h.count("."))] + [("prefix", h + "/" + "/".join(re.findall(r"/([^/?#]+)", url[8 + len(h) :].partition("?")[0])[:k])) for k in range(1, 9)]
            for (lst, kind, key), events in log.items():
                seen, since = False, None
                for t in sorted(events):
                    if t <= at:
                        since = t if events[t] == "add" and not seen else since
                        seen = events[t] == "add"
                if seen and (kind, key) in keys:
                    active.append((lst, since))
        blocked = any(x == "block" for x, _ in active) and not any(x == "allow" for x, _ in active)
        assert (got[page].blocked, got[page].n_active) == (blocked, len(active)), (page, url, at, active)
        if blocked:
            assert got[page].blocked_since.timestamp() == max(s for x, s in active if x == "block")
    assert url_filter.evaluate_captures(p.limit(0), e).count() == 0 and url_filter.evaluate_captures(p, e.limit(0)).where("blocked").count() == 0


def test_sanitising_of_very_many_matches(spark):
    """Spans and rewriting of a text with 4,000 addresses among words, against the plain pattern."""
    text = " ".join(f"u{i % 50}@x{i}.example a{chr(0x400 + i % 90)}😀" for i in range(4000))
    rows = docs_of(spark, [text, "quiet words", None, ""])
    got = {r.doc_id: r for r in sanitise.span_digest(rows).collect()}
    want = brute_base(text)
    assert got[0].n_email == len(want) == 4000 and got[0].base_sha256 == hashlib.sha256(",".join(f"email:{a}:{b}" for a, _, b in want).encode()).hexdigest()
    assert got[1].spans == got[2].spans == ""
    spans = [(int(x.split(":")[1]), int(x.split(":")[2]), sanitise.MARKS[x.split(":")[0]]) for x in got[0].spans.split(",")]
    out, at = "", 0
    for a, b, mark in spans:
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    assert {r.doc_id: r.text for r in sanitise.sanitised(rows).collect()} == {0: out + text[at:], 1: "quiet words", 2: None, 3: ""}


def test_entities_of_the_same_documents_are_judged_alone(spark):
    """PMI and IC from plain counts, by entity; an entity in two documents keeps only what both or few hold."""
    texts = ["ann@x.example bob@x.example alpha beta", "ann@x.example beta gamma", "beta delta"] + [f"common filler w{chr(97 + i)}" for i in range(20)] + ["common ann@x.example alpha"]
    got = {r.doc_id: r.spans for r in sanitise.span_digest(docs_of(spark, texts)).collect()}
    n = len(texts) + 1
    words = [set(re.findall(r"[a-z]+", re.sub(r"[^ ]+@[^ ]+", lambda m: m[0], t))) for t in texts]
    holds = {e: {i for i, t in enumerate(texts) if e in t} for e in ("ann@x.example", "bob@x.example")}
    for i, t in enumerate(texts):
        terms = set()
        for e, docs in holds.items():
            if i in docs:
                for w in words[i]:
                    both, df = sum(w in words[j] for j in docs), sum(w in x for x in words)
                    if math.log(both / len(docs) / ((df + 1) / n)) >= -math.log((len(docs) + 1) / n) / 1.5:
                        terms.add(w)
        places = {(m.start(), m.end()) for m in re.finditer("[a-z]+", t) if m[0] in terms}
        assert {tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("term")} == places


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on small documents with null, empty, repeated and clashing columns."""
    import corpus_pipeline

    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        t = rng.choice(words, 60).tolist()
        if i % 6 == 0:
            t[10:20:3] = ["scoundrel"] * 4
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 0, "x", 0.5, "y", 3))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300, rows[1][1], "en", "s0", 0, "x", 0.5, "y", 3), (301, rows[2][1] + " mail me@here.example", "en", "s1", 0, "x", 0.5, "y", 3), (302, None, None, None, None, None, None, None, None), (303, "", "en", "s1", 0, "x", 0.5, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, toxicity double, m_words string, packed int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    clean = {r.doc_id: r for r in kept.collect()}
    assert len([i for i in range(240) if (i in clean) == (i % 6 == 0)]) <= 3 and {300, 301, 302, 303} <= set(clean) and clean[1].toxicity == 0.5
    unique = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    left = {r.doc_id for r in unique.collect()}
    assert left == set(clean) - {300, 301} and unique.columns == docs.columns
    safe = corpus_pipeline.sanitise_stage(spark, docs, str(tmp_path))
    text = {r.doc_id: r for r in safe.collect()}
    assert text[301].text.endswith(" [TERM] [EMAIL]") and text[301].text.startswith(rows[2][1]) and text[301].spans == "x" and text[1].text == rows[1][1] and text[302].text is None and len(text) == len(rows)
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path))
    taken = {r.doc_id: round(r.taken / r.size) if r.size else 1 for r in mixing.mix(docs)[0].collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {k: v for k, v in taken.items() if v} and mixed.columns == docs.columns
    assert corpus_pipeline.bpe_stage(spark, docs, str(tmp_path)).count() == len(rows)


def test_disclosing_terms_of_one_document(spark):
    """An address in a single document is judged, too; 'the' and 'person' stand in too many documents to disclose it."""
    texts = ["the person Zorblat bob@y.example the"] + [f"the person text number {i} about the weather" for i in range(60)]
    got = {r.doc_id: r.spans for r in sanitise.span_digest(docs_of(spark, texts)).collect()}
    assert "email:19:32" in got[0] and "term:11:18" in got[0] and "term:0:3" not in got[0] and "term:4:10" not in got[0]
    assert got[5] == ""


@pytest.mark.parametrize("pivots", [256, 1_024, 4_096])
def test_pivot_index_recall_with_many_pivots(spark, pivots):
    """Planted pairs at the threshold share enough of their nearest reference points, which are none of them, however many there are."""
    rng = np.random.default_rng(17)
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("size(embedding) = 64").select("embedding").collect()], float)
    root = np.linalg.cholesky(np.cov(x.T) + 1e-9 * np.eye(64))
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    a, p = (unit(x.mean(0) + rng.normal(size=(n, 64)) @ root.T) for n in (2_000, pivots))
    for cosine in (0.93, 0.95):
        r = rng.normal(size=a.shape) @ root.T
        r = unit(r - (r * a).sum(1, keepdims=True) * a)
        near = [np.argpartition(-(v @ p.T), 12, axis=1)[:, :12] for v in (a, cosine * a + math.sqrt(1 - cosine**2) * r)]
        shared = np.array([len(np.intersect1d(u, v)) for u, v in zip(*near)])
        print(pivots, cosine, "shared", pivot_index.shared_of(pivots), "recall", (shared >= pivot_index.shared_of(pivots)).mean(), "with 6", (shared >= 6).mean())
        assert (shared >= pivot_index.shared_of(pivots)).mean() >= 0.95


@pytest.mark.parametrize("pivots, rows", [(64, 1_500), (1_024, 3_000), (4_096, 6_000)])
def test_pivot_index_finds_near_pairs_alone(spark, monkeypatch, pivots, rows):
    """End to end, no exact copies: pairs at cosine 0.93 to 0.95 are the only links, and at least 95 % are found with each number of pivots."""
    for name in ("LEAST_PIVOTS", "MOST_PIVOTS"):
        monkeypatch.setattr(pivot_index, name, pivots)
    rng = np.random.default_rng(23)
    x = rng.normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = rows // 4
    side = rng.normal(size=(pairs, 64))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (pairs, 1))
    x[pairs : 2 * pairs] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side
    made = spark.createDataFrame([(i, v.tolist(), 0, "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score string")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(made).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ~np.eye(rows, dtype=bool)
    found = sum(got[i].n_links for i in range(rows))
    assert near.sum() == 2 * pairs and 0.95 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() and got[i].component_id in (i, i - pairs) for i in range(rows))


def test_pivot_index_of_a_dense_group(spark):
    """Every vector of a group is linked with every other: counts and component are exact, and few rows stand for the pairs."""
    rng = np.random.default_rng(24)
    centre = rng.normal(size=24)
    x = centre + rng.normal(scale=0.05, size=(400, 24))
    rows = [(i, v.tolist(), 0, "s") for i, v in enumerate(x)] + [(500 + i, x[7].tolist(), 0, "s") for i in range(5)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(made, block=64).collect()}
    u = np.concatenate([x, np.repeat(x[7:8], 5, 0)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93).sum(1) - 1
    assert near.min() == 404 and all(r.component_id == 0 for r in got.values())
    counts = np.array([got[r[0]].n_links for r in rows])
    assert (counts <= near).all() and counts.sum() >= 0.99 * near.sum()
    _, links = pivot_index.near_vectors(made, block=64)
    assert links.count() < 10_000


def test_pivot_index_of_a_group_among_others(spark):
    """A third of all rows in one group of near copies: reference points don't crowd in it, and its links are found."""
    rng = np.random.default_rng(26)
    centre, other = rng.normal(size=64), rng.normal(size=(600, 64))
    x = np.concatenate([centre + rng.normal(scale=0.25, size=(300, 64)), other])
    made = spark.createDataFrame([(i, v.tolist(), 0, "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score string")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(made).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93).sum(1) - 1
    counts = np.array([got[i].n_links for i in range(len(x))])
    assert near[:300].mean() > 100 and (counts <= near).all() and counts.sum() >= 0.95 * near.sum()


def test_spanning_forest():
    rng = np.random.default_rng(25)
    for _ in range(100):
        hit = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.3
        u, w = pivot_index._forest(hit)
        assert all(hit[i, j] for i, j in zip(u, w))

        def groups(edges):
            label = list(range(sum(hit.shape)))
            for i, j in edges:
                a, b = sorted((label[i], label[hit.shape[0] + j]))
                label = [a if x == b else x for x in label]
            return label

        assert groups(zip(u, w)) == groups(zip(*np.nonzero(hit))) and len(u) == sum(hit.shape) - len(set(groups(zip(u, w))))


def test_pivot_index_links_vectors_of_a_length_without_pivots(spark, monkeypatch):
    rng = np.random.default_rng(18)
    for name in ("LEAST_PIVOTS", "MOST_PIVOTS", "SAMPLE"):
        monkeypatch.setattr(pivot_index, name, 8)
    rows = [(i, v.tolist(), 0, "s") for i, v in enumerate(rng.normal(size=(200, 8)))]
    odd = [(1_000, [1.0, 0.0, 0.0], 0, "s"), (1_001, [1.0, 0.1, 0.0], 0, "s"), (1_002, [0.0, 0.0, 1.0], 0, "s")]
    points = vectors(spark, rows + odd).orderBy(F.xxhash64("vec_id"), "vec_id").limit(8).collect()
    assert all(len(r.embedding) == 8 for r in points)
    got = {r.vec_id: r for r in pivot_index.near_duplicates(vectors(spark, rows + odd)).collect()}
    assert [got[i].n_links for i in (1_000, 1_001, 1_002)] == [1, 1, 0] and got[1_001].component_id == 1_000


def test_disclosing_terms_of_whole_documents(spark):
    """Terms far from the span and short ones are judged; counts are of whole documents."""
    far = "Zorblat signs for Li Ng. " + "the person text about the weather " * 30 + "bob@y.example"
    texts = [far] + [f"the person text number {i} about the weather for" for i in range(80)]
    spans = {r.doc_id: r.spans for r in sanitise.span_digest(docs_of(spark, texts)).collect()}
    assert all(x in spans[0].split(",") for x in ("term:0:7", "term:18:20", "term:21:23")) and f"term:{far.index('the')}:{far.index('the') + 3}" not in spans[0] and spans[5] == ""


def test_url_keys_of_deep_paths_and_domains(spark):
    host = ".".join("abcdefghijkl")
    row = spark.createDataFrame([(f"https://{host}/1/2/3/4/5/6",)], "url string").select(url_filter.keys_of(F.col("url")).alias("k")).first()
    keys = {(k.kind, k.key) for k in row.k}
    assert ("prefix", f"{host}/1/2/3/4/5/6") in keys and ("domain", host) in keys and ("domain", "k.l") in keys and len(keys) == 1 + 11 + 6


SMALL = "/root/testdata/sf0.001"


def test_codec_queries_equal_the_library(spark):
    """op1 and op7 over the whole table, against the library's ids."""
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALL, "documents").collect()}
    packed = lambda ids: np.array(ids, "<u4").tobytes()
    word, start, want = Tokenizer.from_file(WORD), 0, []
    for i in sorted(texts):
        ids = [*word.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    got = queries.QUERIES["op1_token_store"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    byte, sha = Tokenizer.from_file(BYTE), lambda b: hashlib.sha256(b).hexdigest()
    byte.no_truncation(), byte.no_padding()
    got = {r.doc_id: r for r in queries.QUERIES["op7_bpe"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = byte.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(packed(ids)), sha(byte.decode(ids, skip_special_tokens=False).encode()))


@pytest.mark.parametrize("name, limit", [("op9_quality", 0.3), ("op10_toxicity", 0.5)])
def test_score_queries_cover_the_table(spark, name, limit):
    ids = [r.doc_id for r in common.table(spark, SMALL, "documents").collect()]
    got = queries.QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_run_against_brute_force(spark, monkeypatch):
    """run() over the whole table; each stage's rows against all pairs, SQL or the library on the rows before it."""
    import corpus_pipeline
    import duckdb

    written, stage = {}, corpus_pipeline.stage

    def recorded(df, name):
        written[name] = stage(df, name)
        return written[name]

    monkeypatch.setattr(corpus_pipeline, "stage", recorded)
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *staged: None)
    got = corpus_pipeline.run(spark, SMALL).collect()
    rows = {name: df.collect() for name, df in written.items()}
    docs = common.table(spark, SMALL, "documents")
    assert list(rows) == [n for n, _ in corpus_pipeline.STAGES[:-1]] and all(df.columns == docs.columns for df in written.values())
    toxic = {r.doc_id for r in queries.QUERIES["op10_toxicity"](spark, SMALL).collect() if r.predicted}
    assert sorted(rows["toxicity"], key=lambda r: r.doc_id) == sorted((r for r in docs.collect() if r.doc_id not in toxic), key=lambda r: r.doc_id)
    before = sorted(rows["toxicity"], key=lambda r: r.doc_id)
    leaders = [before[i] for i, g in enumerate(brute_groups([r.text for r in before], len(before))) if g == i]
    assert sorted(rows["near_duplicates"], key=lambda r: r.doc_id) == leaders
    sql = lambda name, text: duckdb.sql(f"WITH RECURSIVE documents AS (SELECT * FROM '{written[name].staged_at}/*.parquet'), {text.strip().removeprefix('WITH RECURSIVE')}").df()
    spans = {r.doc_id: r.spans for r in sql("near_duplicates", queries.SQL["op6_sanitise"]).itertuples()}
    safe = {}
    for r in leaders:
        out, at = "", 0
        for kind, a, z in (x.split(":") for x in spans[r.doc_id].split(",") if x):
            if int(a) >= at:
                out += r.text[at : int(a)] + sanitise.MARKS[kind]
            at = max(at, int(z))
        safe[r.doc_id] = r.text if r.text is None else out + r.text[at:]
    assert {r.doc_id: r.text for r in rows["sanitise"]} == safe and len(rows["sanitise"]) == len(leaders) and any("[EMAIL]" in (t or "") for t in safe.values())
    mixed = sql("sanitise", queries.SQL["op5_mixing"])
    times = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 1 for r in mixed.itertuples()}
    assert collections.Counter(r.doc_id for r in rows["mixing"]) == {i: k for i, k in times.items() if k}
    byte, sha = Tokenizer.from_file(BYTE), lambda b: hashlib.sha256(b).hexdigest()
    byte.no_truncation(), byte.no_padding()
    want = collections.Counter()
    for r in rows["mixing"]:
        ids = byte.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(byte.decode(ids, skip_special_tokens=False).encode())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    for df in written.values():
        common.discard(df)


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = docs_of(spark, ["x"]).limit(0)
    for name, work in corpus_pipeline.STAGES[1:]:
        out = work(spark, docs, SMALL)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)
