"""Near-duplicate documents: improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

Shingles are five lower-cased words; a shingle's weight is its count times an idf between 1 and 2.
Document frequencies of all documents stand in a count-mean-min sketch whose size grows with their
number up to a bound.  Samples are banded; documents that share a band are candidates and are
verified by weighted Jaccard similarity.

Equal word sequences are one class and are not compared.  Within a band's bucket every document is
first compared with a few leaders, which is linear; then documents outside their bucket's largest
component are compared, in tiles, with all others of the bucket.  Every candidate pair of different
components is verified, and none is emitted as a row.  Texts reach a task sorted by the work they
are for and pass through it one after another: what a task holds is one leader, or one tile's side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_POWERS, components, counter_rows, discard, merged_counters, powers, slices, stage, texts_of

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 12
#: Counters in a row of the sketch, as powers of two: at least and at most (32 MB to broadcast).  With c counters a count
#: of s shingles is off by about sqrt(s / c), and idf by log(1 + that) / log(documents) of its range of 1.
SKETCH_ROWS, SKETCH_BITS, MOST_BITS = 2, 20, 22
LEADERS = 4
#: A leader's members, and a tile's side: so many texts, or fewer if they are longer than so many bytes together.
GROUP, GROUP_BYTES = 256, 4_000_000
SMALL = 16
#: Ids up to this many (16 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
TABLE_BITS = 16

_rng = np.random.default_rng(20_101)
_MIX = _rng.integers(1, 2**63, 64 + WORDS + SKETCH_ROWS, dtype=np.uint64) | np.uint64(1)
_WORD_MIX, _SKETCH_MIX, _SAMPLE_MIX = _MIX[:WORDS], _MIX[WORDS : WORDS + SKETCH_ROWS], _MIX[WORDS + SKETCH_ROWS :]
# Variates of the sampling: Gamma(2, 1) steps, logarithms of Gamma(2, 1), and uniform shifts.
_STEP = _rng.gamma(2.0, 1.0, 2**TABLE_BITS).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 2**TABLE_BITS)).astype(np.float32)
_SHIFT = _rng.random(2**TABLE_BITS).astype(np.float32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text in turn, and how many each text has.

    Words are runs of bytes other than ASCII white space; their hashes come from running sums of
    byte * factor ** place over the whole batch.
    """
    raw = [t.lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    each = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)])))
    up, down = powers(max(LEAST_POWERS, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), each


def sequence_keys(words: np.ndarray, each: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each text's word sequence; null for a text without words."""
    keys: list[bytes | None] = [None] * len(each)
    full = np.flatnonzero(each)
    if len(full):
        starts = np.cumsum(each[full]) - each[full]
        place = np.arange(len(words)) - np.repeat(starts, each[full])
        up, down = powers(max(LEAST_POWERS, 1 << int(each.max()).bit_length()))
        both = np.stack([np.add.reduceat(words * p[place], starts) for p in (up, down)], axis=1).astype("<u8")
        for k, row in zip(full.tolist(), both):
            keys[k] = row.tobytes()
    return keys


def shingle_counts(words: np.ndarray, lens: np.ndarray):
    """Distinct shingles of each document in turn: (hashes, counts, how many each document has).

    A text of one to four words has one shingle; an empty one has none.
    """
    padded = np.where(lens > 0, np.maximum(lens, WORDS), 0)
    flat = np.zeros(int(padded.sum()), np.uint64)
    starts = np.cumsum(padded) - padded
    place = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
    flat[place] = words
    n = max(0, len(flat) - WORDS + 1)
    value = np.zeros(n, np.uint64)
    for i in range(WORDS):
        value += flat[i : i + n] * _WORD_MIX[i]
    doc = np.repeat(np.arange(len(lens)), padded)
    inside = doc[:n] == doc[WORDS - 1 :] if n else np.zeros(0, bool)
    value, doc = mix(value[inside]), doc[:n][inside]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(value)))
    return value[first], counts, np.bincount(doc[first], minlength=len(lens))


def sketch_of(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of all shingles of all rows (a table of bounded size), and the number of rows."""
    bits = min(MOST_BITS, max(SKETCH_BITS, (docs.count() // 4).bit_length()))
    width = 2**bits

    def count(batches):
        table = np.zeros((SKETCH_ROWS, width), np.int64)
        rows = np.zeros((1, width), np.int64)
        for batch in slices(batches):
            value, _, _ = shingle_counts(*word_hashes(texts_of(batch)))
            for i, m in enumerate(_SKETCH_MIX):
                table[i] += np.bincount((value * m) >> np.uint64(64 - bits), minlength=width)
            rows[0, 0] += batch.num_rows
        yield from counter_rows(np.concatenate([table, rows]))

    total = merged_counters(docs.select("text").mapInArrow(count, "slot int, data binary"), SKETCH_ROWS + 1, width)
    return total[:SKETCH_ROWS].astype(np.uint32 if total.max() < 2**32 else np.int64), int(total[SKETCH_ROWS, 0])


def idf_of(value: np.ndarray, sketch: np.ndarray, rows: int) -> np.ndarray:
    """1 for shingles in every document to 2 for rare ones; the sketch's mean load is taken off."""
    width, bits = sketch.shape[1], sketch.shape[1].bit_length() - 1
    total = float(sketch[0].sum(dtype=np.float64))
    best = np.full(len(value), np.inf)
    for i, m in enumerate(_SKETCH_MIX):
        c = sketch[i][((value * m) >> np.uint64(64 - bits)).astype(np.int64)].astype(np.float64)
        best = np.minimum(best, c - (total - c) / (width - 1))
    return np.clip(1 + np.log((rows + 1) / (np.maximum(best, 1) + 1)) / math.log(rows + 1.0 + 1e-9), 1, 2)


def band_keys(value: np.ndarray, weight: np.ndarray, each: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; documents without shingles have rows of zeros."""
    out = np.zeros((len(each), BANDS), np.uint64)
    full = np.flatnonzero(each)
    if not len(full):
        return out
    lens = each[full]
    starts = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(full)), lens)
    log_w = np.log(weight).astype(np.float32)
    first = np.empty(len(full), np.int64)
    for k in range(ROWS * BANDS):
        at = ((value * _SAMPLE_MIX[k % len(_SAMPLE_MIX)]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        step, shift = _STEP[at], _SHIFT[at]
        level = np.floor(log_w / step + shift)
        log_a = _LOG_C[at] - step * (level - shift) - step
        hits = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), lens))[::-1]
        first[doc[hits]] = hits
        sample = mix(value[first] + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[full, k // ROWS] = mix(out[full, k // ROWS] * np.uint64(31) + sample + np.uint64(k))
    return out


def _elements(texts, sketch, rows):
    """Per document: hashes, and weights of counts times idf."""
    value, counts, each = shingle_counts(*word_hashes(texts))
    weight = counts * idf_of(value, sketch, rows)
    cuts = np.cumsum(each)[:-1]
    return list(zip(np.split(value, cuts), np.split(weight, cuts)))


def weighted_jaccard(a, b) -> float:
    """Sum of least weights over sum of largest, of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    common = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def near_duplicate_classes(docs: DataFrame, *, threshold: float = THRESHOLD, leaders: int = LEADERS, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id and class_id (smallest doc_id of the class) of every row of ``docs``.

    Null and empty texts are in no class but their own; so are rows without an id (class null).
    Rows that share an id belong to one class if any of them does; each of their texts is compared.
    """
    spark = docs.sparkSession
    sketch, rows = sketch_of(docs)
    held = spark.sparkContext.broadcast(sketch)

    def sign(batches):
        for batch in slices(batches):
            texts = texts_of(batch)
            words, lens = word_hashes(texts)
            value, counts, each = shingle_counts(words, lens)
            keys = band_keys(value, counts * idf_of(value, held.value, rows), each).view(np.int64)
            same = sequence_keys(words, lens)
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(same, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["t", "same", "size", "bands"])

    # A text is known by its id and its hash, so that rows of one id with different texts stay apart.
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    usual = docs.where("doc_id is not null and text is not null").select(key.alias("t"), "text")
    signed = stage(usual.mapInArrow(sign, "t struct<id: long, hash: long>, same binary, size long, bands array<long>"), "signatures").where("same is not null")
    # Rows of one word sequence have the same bands; the smallest id stands for them.
    equal = stage(signed.groupBy("same").agg(F.min(F.struct("t", "size")).alias("first"), F.any_value("bands").alias("bands")).select("same", "first.t", "first.size", "bands"), "equal-texts")

    def texts(keys: DataFrame) -> DataFrame:
        """t and text of the given rows (t); few enough are broadcast, so that no text is shuffled to find them."""
        keys = stage(keys, "wanted")
        few = keys.count() <= BROADCAST_IDS
        return usual.join(F.broadcast(keys) if few else keys, "t", "left_semi").dropDuplicates(["t"])

    posts = equal.select("t", "size", F.posexplode("bands").alias("band", "key"))
    posts = stage(posts.join(_buckets(posts, leaders), ["band", "key"]).select("band", "key", "t", "n", "bytes", "first"), "postings")
    # Small buckets: all their pairs, a bounded number for each; large ones: each text with the leaders.
    small = posts.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.collect_list("t").alias("ts"))
    small = small.select(F.explode("ts").alias("x"), "ts").select("x", F.explode("ts").alias("y")).where("x < y")
    star = posts.where(F.col("n") > SMALL).select("t", F.explode("first").alias("leader")).where("t <> leader").select(F.least("t", "leader").alias("x"), F.greatest("t", "leader").alias("y"))
    lead = F.xxhash64("x") < F.xxhash64("y")
    pairs = small.union(star).distinct().select(F.when(lead, F.col("x")).otherwise(F.col("y")).alias("leader"), F.when(lead, F.col("y")).otherwise(F.col("x")).alias("member"))
    pairs = stage(pairs, "pairs")
    wanted = stage(texts(pairs.select(F.col("leader").alias("t")).union(pairs.select("member")).distinct()), "texts")

    def near(batches):
        lead = own = None
        for batch in slices(batches):
            found = ([], [])
            for work, first, t, part in zip(batch.column("work").to_pylist(), batch.column("first").to_pylist(), batch.column("t").to_pylist(), _elements(texts_of(batch), held.value, rows)):
                if first:
                    lead, own = work, part
                elif work == lead and t["id"] != work["leader"]["id"] and weighted_jaccard(own, part) >= threshold:
                    found[0].append(work["leader"]["id"])
                    found[1].append(t["id"])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in found], ["a", "b"])

    # A leader of many members is sent to several tasks: one row for every ``group`` of pairs at most.
    many = stage(pairs.groupBy("leader").agg(F.ceil(F.count("*") / group).alias("parts")).where("parts > 1"), "hot-leaders")
    few = many.count() <= BROADCAST_IDS // 4
    work = F.struct("leader", F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).alias("part")).alias("work")
    members = pairs.join(F.broadcast(many) if few else many, "leader", "left").select(work, F.lit(False).alias("first"), F.col("member").alias("t"))
    links = stage(_in_order(members.union(members.select("work", F.lit(True), "work.leader").distinct()), wanted).mapInArrow(near, "a long, b long").distinct(), "links")
    known = stage(components(links), "components")

    # Documents outside the largest component of their bucket meet all others of the bucket.
    large = posts.where(F.col("n") > SMALL).select("band", "key", "t", "bytes").join(known, F.col("t.id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "t.id"))
    tally = large.groupBy("band", "key", "component").agg(F.count("*").alias("m"))
    # Set down first, so that the join below may split a hot bucket.
    most = stage(tally.groupBy("band", "key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n")).where("n > top.m").select("band", "key", F.col("top.component").alias("main"), "n"), "open-buckets")
    blocks = F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("bytes") / group_bytes))
    open_ = large.join(most, ["band", "key"]).select("band", "key", "t", "component", "main", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")))
    open_ = stage(open_, "open-buckets")
    odd = open_.where("component <> main")
    left = odd.select("band", "key", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("first"), "t", "component")
    right = open_.withColumnRenamed("block", "j").join(odd.select("band", "key", F.col("block").alias("i")).distinct(), ["band", "key"]).select("band", "key", "i", "j", F.lit(False).alias("first"), "t", "component")
    tiles = left.union(right).select(F.struct("band", "key", "i", "j").alias("work"), "first", "t", "component")

    def cross(batches):
        tile, side, met = None, [], []
        for batch in slices(batches):
            found = ([], [])
            for work, first, t, component, part in zip(batch.column("work").to_pylist(), batch.column("first").to_pylist(), batch.column("t").to_pylist(), batch.column("component").to_pylist(), _elements(texts_of(batch), held.value, rows)):
                if work != tile:
                    tile, side, met = work, [], []
                if first:
                    side.append((t["id"], part))
                    met.append({component})
                    continue
                for (id, own), seen in zip(side, met):
                    # One link to each other component is enough.
                    if component not in seen and weighted_jaccard(own, part) >= threshold:
                        seen.add(component)
                        found[0].append(id)
                        found[1].append(t["id"])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in found], ["a", "b"])

    more = stage(_in_order(tiles, texts(open_.select("t").distinct())).mapInArrow(cross, "a long, b long"), "links")
    linked = known if more.isEmpty() else components(links.union(more))
    classes = equal.select("same", F.col("t.id").alias("rep")).join(linked, F.col("rep") == F.col("id"), "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    found = signed.select(F.col("t.id").alias("doc_id"), "same").join(classes, "same").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    discard(posts, pairs, wanted, most, open_, many)
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _in_order(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (work, first, t and more) with their text; the rows of one work stand together, those with ``first`` before the others."""
    return rows.join(texts, "t").repartition("work").sortWithinPartitions("work", F.desc("first"))


def _buckets(posts: DataFrame, leaders: int) -> DataFrame:
    """Buckets of at least two texts: their size, their bytes and their leaders (smallest hashes)."""
    salted = posts.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(64)))
    # The least of each part: a large bucket is never gathered.
    part = salted.groupBy("band", "key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("first"))
    whole = part.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.slice(F.array_sort(F.collect_list("first")), 1, leaders).alias("first"))
    return whole.where("n > 1").select("band", "key", "n", "bytes", F.expr("transform(first, x -> x.t)").alias("first"))


def near_duplicate_kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class; rows without an id stay."""
    classes = near_duplicate_classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(classes, docs.doc_id == classes.dropped_id, "left_anti")
