"""Queries against their SQL on small tables of the kinds that larger ones hold."""

import datetime as dt
import itertools
import os
import unicodedata

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.llm import token_store
from tickloom.llm.token_store import SETTLED, WordEncoder
from tickloom.plans import load
from tickloom.streaming import stateful as SF
from tickloom.streaming import streams as ST
from test_library import plain

QUERIES, SQL = load()


def same(spark, name, folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.partition('.')[0]} as select * from '{folder}/{f}/*.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(folder))
    assert got.columns == columns
    assert plain([tuple(r) for r in got.collect()], columns) == plain(want.fetchall(), columns)
    return got


@pytest.fixture(scope="module")
def zero_prices(spark, tmp_path_factory):
    """Hours whose least value, or whose only one, is zero."""
    folder = tmp_path_factory.mktemp("zero")
    values = {"view": [(0, 0.0), (0, 5.0), (1, 7.0), (2, 0.0), (3, 2.0), (3, 150.0)], "error": [(0, 1.0), (1, 2.0), (1, 3.0), (2, 4.0)], "click": [(0, 3.0), (1, 0.0), (1, 2.0), (2, 1.0)]}
    rows = [(dt.datetime(2024, 1, 1, h, i), t, v) for t, vs in values.items() for i, (h, v) in enumerate(vs)]
    events = spark.createDataFrame([(i, ts, 1, t, v, "{}") for i, (ts, t, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")
    return folder


def test_market_history_sets_bars_with_a_low_of_zero_aside(spark, zero_prices):
    same(spark, "read_market_history", zero_prices)


def test_spreads_of_bars_with_a_price_of_zero(spark, zero_prices):
    same(spark, "spread_estimators", zero_prices)


@pytest.fixture(scope="module")
def bounds(spark, tmp_path_factory):
    """Suppliers with the same rows in every order: each month's means are equal, and its mean discount stands on a bound (0.03, then 0.05)."""
    folder = tmp_path_factory.mktemp("bounds")
    months = {dt.datetime(1996, 5, 3): ([0.01, 0.01, 0.03, 0.04, 0.06], [10000.01, 20000.02, 30000.03, 40000.07, 50000.11]), dt.datetime(1996, 8, 3): ([0.0, 0.03, 0.05, 0.07, 0.1], [10000.02, 20000.07, 30000.01, 40000.03, 49999.87])}
    rows = []
    for ts, (discounts, prices) in months.items():
        for supplier, order in enumerate(itertools.permutations(range(5))):
            rows += [(len(rows) + i, 1, supplier, 1, 20.0, prices[k], discounts[k], discounts[-1 - k], "N", "O", ts) for i, k in enumerate(order)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(120)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return folder


def by_month(spark, name, folder, column):
    """The distinct values of each month, months in order."""
    rows = same(spark, name, folder).groupBy("ts").agg(F.array_sort(F.collect_set(column)).alias("v")).orderBy("ts").collect()
    return [r.v for r in rows]


def test_a_mean_on_the_bound_is_eligible_in_any_order(spark, bounds):
    assert by_month(spark, "eligibility", bounds, F.coalesce("reason", F.lit("none"))) == [["none"], ["none"]]


def test_equal_means_have_equal_percentiles(spark, bounds):
    assert all(len(v) == 1 for v in by_month(spark, "percentile_score", bounds, "composite"))


def test_equal_means_are_placed_by_id(spark, bounds):
    assert by_month(spark, "rank_ids", bounds, F.col("place") - F.col("asset")) == [[1], [1]]


def test_hybrid_scores_of_means_on_a_split(spark, bounds):
    assert all(len(v) == 1 for v in by_month(spark, "score_linear_hybrid", bounds, "score"))


def test_a_mean_on_a_split_goes_left_in_any_order(spark, bounds):
    """Means of 30000.048 and 29999.999 before and after July; 0.03 and 0.05 are at most 0.05."""
    assert by_month(spark, "score_trees", bounds, "score") == [[0.35], [-0.4]]


def test_notices_of_a_small_file_are_read_by_all_cores(spark):
    notices = QUERIES["read_notice_tables"](spark, "/root/testdata/sf0.001")
    assert notices.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


class State:
    """State of one key and its timers in memory; counts the calls that a processor makes."""

    def __init__(self):
        self.calls, self.value, self.pairs, self.timers = 0, None, {}, set()

    def _called(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def containsKey(self, key):  # noqa: N802
        return self._called(key in self.pairs)

    def getValue(self, key):  # noqa: N802
        return self._called(self.pairs[key])

    def updateValue(self, key, value):  # noqa: N802
        self.pairs[key] = self._called(value)

    def removeKey(self, key):  # noqa: N802
        self._called(self.pairs.pop(key))

    def registerTimer(self, ms):  # noqa: N802
        self._called(self.timers.add(ms))

    def deleteTimer(self, ms):  # noqa: N802
        self._called(self.timers.remove(ms))


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.ms


HOUR = 3_600_000_000


def fills(ids, us=lambda i: i * HOUR, price=2.0):
    return iter([Row(user_id=1, us=us(i), event_id=i, qty=1.0, price=price) for i in ids])


def test_positions_call_their_state_less_than_once_for_each_fill():
    state = State()
    p = SF.Positions("user_id", span_us=96 * HOUR)
    p.init(state)
    (row,) = p.handleInputRows((1,), fills(range(200)), None)
    assert (row.qty, row.fills) == (200.0, 200) and state.calls < 20
    before = state.calls
    assert list(p.handleInputRows((1,), fills(range(200)), None)) == [] and state.calls - before < 10


def test_positions_of_a_busy_key_lie_in_small_buckets_and_are_forgotten():
    """Ids patterned and split over many buckets are known at any other time, until their span is over; a micro-batch of one fill reads one bucket."""
    state = State()
    p = SF.Positions("user_id", span_us=2000 * HOUR)
    p.init(state)
    for a in range(0, 10_000, 2500):
        list(p.handleInputRows((1,), fills(range(a, a + 2500)), None))
    assert sum(len(v[0]) for v in state.pairs.values()) == 10_000 and max(len(v[0]) for v in state.pairs.values()) < 2 * p.FULL
    before = state.calls
    assert list(p.handleInputRows((1,), fills(range(0, 10_000, 1000), us=lambda i: 9_999 * HOUR), None)) == [] and state.calls - before <= 21
    for ms in sorted(state.timers)[:3]:
        list(p.handleExpiredTimer((1,), None, Expired(ms)))
    assert sorted(i for v in state.pairs.values() for i in v[0]) == list(range(6000, 10_000))
    assert state.value[2:4] == (10_000, 4000)
    for ms in sorted(state.timers)[3:]:
        list(p.handleExpiredTimer((1,), None, Expired(ms)))
    assert state.pairs == {} and state.value[2:] == (10_000, 0, 1)


def test_a_cooldown_reads_its_state_once():
    state = State()
    c = SF.Cooldown("user_id", 30.0, HOUR)
    c.init(state)
    rows = lambda *values: iter([Row(user_id=1, us=k, event_id=k, value=v) for k, v in enumerate(values)])
    assert list(c.handleInputRows((1,), rows(1.0, None, 2.0), None)) == [] and state.calls == 1
    assert [tuple(r) for r in c.handleInputRows((1,), rows(1.0, 40.0), None)] == [(1, 1, 1, 40.0, "open")] and state.calls == 4


def test_known_words_are_looked_up_once():
    """The library's ids; words that are known from an earlier text take one look into the cache."""

    class Once(dict):
        def __getitem__(self, word):
            assert word in new
            return super().__getitem__(word)

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.cache, new = Once(), {"the", "quick", "fox", "déjà", "vu"}
    texts = ["The quick fox\tthe\x0bFOX", "Déjà vu the", "", "\x00 the", "ΑΣ"]
    for _ in range(2):
        assert encoder.encode(texts) == encoder._ask(texts)
        new = set()


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_a_cooldown_calls_its_state_once_for_a_shard_of_keys():
    """Holds of 500 keys take one read, one write and one timer; those that the watermark has passed end together, the next timer stands for the rest."""
    state, ms = State(), HOUR // 1000
    c = SF.Cooldown("user_id", 30.0, HOUR)
    c.init(state)
    rows = [Row(user_id=k, us=1000 * k, event_id=-k, value=40.0) for k in range(500)]
    opened = list(c.handleInputRows((7,), iter(rows), At(-1)))
    assert sorted(map(tuple, opened)) == [(k, 1000 * k, -k, 40.0, "open") for k in range(500)]
    assert state.calls == 3 and state.timers == {ms}
    told = list(c.handleExpiredTimer((7,), At(ms + 99), Expired(ms)))
    assert sorted(map(tuple, told)) == [(k, 1000 * k + HOUR, -k, 40.0, "exit") for k in range(100)]
    assert state.calls == 6 and state.timers == {ms, ms + 100}
    state.timers.remove(ms)
    last = list(c.handleInputRows((7,), iter([Row(user_id=k, us=2 * HOUR, event_id=9, value=None) for k in range(100, 500)]), At(ms + 99)))
    assert len(last) == 400 and {r.kind for r in last} == {"exit"} and state.value is None and state.timers == set()


def test_a_cooldown_of_many_keys_in_one_shard_is_that_of_each_key(spark):
    """Text keys and a null one, two deliveries, holds that end at the watermark itself; one shard, and as many as there are."""
    start = dt.datetime(2024, 1, 1)
    make = lambda rows: SF.with_micros(spark.createDataFrame([(k, start + dt.timedelta(minutes=m), e, v) for k, m, e, v in rows], "key string, ts timestamp, event_id long, value double"))
    first = [("a", 0, 1, 9.0), ("c", -1, 2, 9.0), (None, 0, 3, 9.0), ("b", 11, 4, 1.0)]
    second = [("a", 30, 5, 9.0), ("c", 30, None, 9.0), ("b", 90, 7, 9.0)]
    for shards in (1, SF.SHARDS):
        out, _ = ST.run_deliveries([make(r) for r in (first, second)], lambda s: SF.cooldown(s, "key", 5.0, 600, shards), "t", watermark="1 minute")
        rows = out.collect()
        began = min(r.us for r in rows) + 60_000_000
        got = sorted(((r.us - began) // 60_000_000, str(r.key), str(r.event_id), r.kind) for r in rows)
        assert got == [(-1, "c", "2", "open"), (0, "None", "3", "open"), (0, "a", "1", "open"), (9, "c", "2", "exit"), (10, "None", "3", "exit"), (10, "a", "1", "exit"), (30, "a", "5", "open"), (30, "c", "None", "open"), (40, "a", "5", "exit"), (40, "c", "None", "exit"), (90, "b", "7", "open")]


def test_words_of_many_texts_are_looked_up_once():
    """The library's ids; each distinct word of a call takes one look into the cache, however often it stands there, and Arrow's white space is Python's."""

    class Counted(dict):
        looks = 0

        def get(self, word, *rest):
            self.looks += 1
            return super().get(word, *rest)

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.cache = Counted()
    texts = ["the fox " * 300, "  The\tfox", "", " \n", "déjà　the\x85fox vu ", "\x1c the"]
    for _ in range(2):
        encoder.cache.looks = 0
        assert encoder.encode(texts) == encoder._ask(texts) and encoder.cache.looks <= 5
    assert encoder.encode([]) == [] and encoder.encode(["\x00"]) == encoder._ask(["\x00"])
    spaced = [f"a{c}b" for c in map(chr, range(0x10000)) if SETTLED.fullmatch(c)]
    assert [[w for w in x if w] for x in pc.utf8_split_whitespace(pa.array(spaced)).to_pylist()] == list(map(str.split, spaced))


def test_letters_and_the_punctuation_behind_them_are_known_apart():
    """The library's ids; a word before many marks is learned once, and each run of marks too."""
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    marks = ["", ".", ",", "!?", "###", "'", "...", "\\]"]
    texts = [f"{w}{m} {w.upper()}{m}" for w in ("fox", "déjà", "日本語") for m in marks]
    assert encoder.encode(texts) == encoder._ask(texts)
    assert set(encoder.cache) == {"fox", "déjà", "日本語", *marks}
    odd = ["it's. don't, 'twas x''s s' 's' 's. dogs'll' i'd'", "a1. 1. 1,000.50! ½. ²) ª. x_y_ _x_ (fox) --fox-- .fox", "fox… fox。 «fox». 日本、語。 ... ' '' .'s", "İ. ß! ǆ, ﬁ. e\u0301. 가.", "x" * 5000 + "7" + "y" * 200 + "!", "a+b=c a+b=d user@mail.example.com"]
    for _ in range(2):
        assert encoder.encode(odd) == encoder._ask(odd)
    settled = [x for c in map(chr, range(0x10000)) if SETTLED.fullmatch(c) for x in unicodedata.normalize("NFC", c).lower()]
    assert pc.utf8_is_alpha(pa.array(settled)).to_pylist() == [bool(regex.match(r"\p{L}", c)) for c in settled]


@pytest.mark.parametrize("bound", ["CACHED_WORDS", "CACHED_IDS"])
def test_known_words_are_forgotten_beyond_a_bound(monkeypatch, bound):
    monkeypatch.setattr(token_store, bound, 20)
    encoder, sizes = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    for i in range(12):
        texts = [f"{chr(97 + i)}{chr(97 + k)}zzqx the." for k in range(8)]
        assert encoder.encode(texts) == encoder._ask(texts)
        sizes.append((len(encoder.cache), len(encoder.ids)))
    assert max(n for n, _ in sizes) <= 20 + 10 if bound == "CACHED_WORDS" else max(n for _, n in sizes) <= 20 + 80


def test_words_met_again_stay_known_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_WORDS", 20)
    encoder, asked = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    piece = encoder._piece
    encoder._piece = lambda word: asked.append(word) or piece(word)
    for i in range(12):
        texts = [f"the {chr(97 + i)}{chr(97 + k)}zzq Fox" for k in range(8)]
        assert encoder.encode(texts) == encoder._ask(texts)
    assert asked.count("the") == asked.count("fox") == 1 and len(asked) == 2 + 12 * 8 and len(encoder.cache) < 30
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + k)}q" for i in range(5) for k in range(5))]
    for _ in range(3):
        assert encoder.encode(texts) == encoder._ask(texts) and len(encoder.cache) <= 21 + 26
