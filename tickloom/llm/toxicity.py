"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Tokens are counted by document over the whole corpus in a table of fixed size (hashed words and
   word stems); labelled training documents also count by class, copies of a text once.
2. A token's score is the lower confidence bound of its log-odds between the classes under a
   Dirichlet prior that has the corpus' own proportions, less a small drift.
3. A linear-time scan (Ruzzo and Tompa, 1999) finds every maximal scoring segment of a document.
4. The largest score of clean documents follows an extreme-value law whose parameters are fitted: in
   n words, segments of score s or more are Poisson with mean E(s) = scale n exp(-rate s).  Segments
   of small E-value are significant, and their -log E sums to the document's surprise.  Beside it
   stands that of its r best segments for the best r, -log P(Poisson(E(s_r)) >= r), by which many
   weak passages of a long text count as well (Karlin and Altschul, 1993).  A logistic link of both
   makes the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_POWERS, bounded_labels, counter_rows, discard, merged_counters, powers, slices, stage, texts_of

BUCKETS = 2**18
STEMS = (4, 6)
DRIFT = 1.0
#: Labels are learned from at most this many rows (smallest id hashes).
TRAIN_ROWS = 50_000
PRIOR_FLOOR, PRIOR_WEIGHT = 0.5, 50.0
Z = 2.5
E_LIMIT = 0.05


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words of each text in turn, and how many words each text has.

    Words are runs of letters, digits and bytes beyond ASCII of the lower-cased text.  Features are
    the word and its first 4 and 6 bytes; a word too short for a stem repeats its own.
    """
    raw = [t.lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    each = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)])))
    # A hash of any run of bytes from running sums of byte * factor ** place.
    up, down = powers(max(LEAST_POWERS, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    out = np.empty((len(starts), 1 + len(STEMS)), np.int64)
    base, back = sums[starts], down[starts]
    for k, n in enumerate((None, *STEMS)):
        stop = ends if n is None else np.minimum(starts + n, ends)
        h = (sums[stop] - base) * back
        if n is not None:
            h = np.where(stop < ends, h + np.uint64(n), (sums[ends] - base) * back)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (h >> np.uint64(40)) & np.uint64(BUCKETS - 1)
    return out, each


@dataclass
class ToxicityModel:
    """Token scores (fixed size), the extreme-value law of clean documents, and a logistic link."""

    scores: np.ndarray
    rate: float = 1.0
    scale: float = 1e-6
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = 0.0
    clean: int = 0
    toxic: int = 0
    notes: dict = field(default_factory=dict)


def maximal_segments(at: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first word, last word, score) in linear time.

    ``values`` are the scores of the words at places ``at``, above zero; all other words score ``-drift``.
    """
    kept: list[list] = []  # first, last, sum before, sum after, candidate to its left with a smaller sum before
    total, seen = 0.0, 0
    for place, value in zip(at, values):
        total -= drift * (place - seen)
        seen = place + 1
        segment = [place, place, total, total + value, -1]
        total += value
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= segment[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= segment[3]:
                segment[4] = j
                kept.append(segment)
                break
            segment = [kept[j][0], segment[1], kept[j][2], segment[3], -1]
            del kept[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in kept]


def _segments(scores: np.ndarray, texts: list[str]):
    """Number of words and maximal segments of each text."""
    found, lens = word_features(texts)
    score = scores[found].max(axis=1) - DRIFT if len(found) else np.zeros(0)
    hot = np.flatnonzero(score > 0)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    cuts = np.searchsorted(hot, bounds)
    for i in range(len(texts)):
        places = hot[cuts[i] : cuts[i + 1]]
        yield int(lens[i]), maximal_segments((places - bounds[i]).tolist(), score[places].tolist(), DRIFT) if len(places) else []


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the training fold of ``labels``; corpus counts cover every row of ``docs``."""
    spark = docs.sparkSession
    chosen = bounded_labels(labels, column, train_rows)
    # A bounded table (train_rows rows): broadcast.  Copies of a text count once, under their smallest id.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "label").agg(F.min("doc_id").alias("doc_id"))
    train = stage(sample.select("doc_id", "label"), "toxicity-train")

    def count(batches):
        counts = np.zeros((3, BUCKETS), np.int64)
        sizes = np.zeros((1, BUCKETS), np.int64)
        for batch in slices(batches):
            texts = texts_of(batch)
            kind = np.array([2 if x is None else min(max(x, 0), 1) for x in batch.column("label").to_pylist()])
            found, each = word_features(texts)
            if len(found):
                pair = np.unique(np.repeat(np.arange(len(texts)), each)[:, None] * BUCKETS + found)
                counts += np.bincount(kind[pair // BUCKETS] * BUCKETS + pair % BUCKETS, minlength=3 * BUCKETS).reshape(3, BUCKETS)
            sizes[0, :3] += np.bincount(kind, minlength=3)
        yield from counter_rows(np.concatenate([counts, sizes]))

    joined = docs.select("doc_id", "text").join(F.broadcast(train.dropDuplicates(["doc_id"])), "doc_id", "left").select("text", "label")
    total = merged_counters(joined.mapInArrow(count, "slot int, data binary"), 4, BUCKETS)
    clean, toxic = float(total[3, 0]), float(total[3, 1])
    if not clean or not toxic:
        share = (toxic + 1) / (clean + toxic + 2)
        return ToxicityModel(np.zeros(BUCKETS), offset=math.log(share / (1 - share)), clean=int(clean), toxic=int(toxic))
    corpus = total[:3].sum(axis=0) / max(1.0, float(total[3, :3].sum()))
    prior = PRIOR_FLOOR + PRIOR_WEIGHT * corpus
    spare = PRIOR_FLOOR + PRIOR_WEIGHT * (1 - np.minimum(corpus, 1))
    y0, y1 = total[0], total[1]
    odds = np.log((y1 + prior) / (toxic - y1 + spare)) - np.log((y0 + prior) / (clean - y0 + spare))
    spread = np.sqrt(1 / (y1 + prior) + 1 / (toxic - y1 + spare) + 1 / (y0 + prior) + 1 / (clean - y0 + spare))
    model = ToxicityModel(np.maximum(odds - Z * spread, 0.0), clean=int(clean), toxic=int(toxic))

    held = spark.sparkContext.broadcast(model.scores)

    def measure(batches):
        for batch in slices(batches):
            rows = [(n, sorted((s for *_, s in found), reverse=True)) for n, found in _segments(held.value, texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([n for n, _ in rows], pa.int64()), pa.array([x[0] if x else 0.0 for _, x in rows], pa.float64()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["label", "words", "most", "sums"])

    # As many rows as there are training texts, unless ids repeat: at most twice that many are learned from.
    rows = docs.select("doc_id", "text").join(F.broadcast(train.dropDuplicates(["doc_id"])), "doc_id").select("text", "label").mapInArrow(measure, "label int, words long, most double, sums array<double>")
    rows = stage(rows, "toxicity-segments")
    null = rows.where("label = 0").select("words", "most").limit(2 * train_rows).toPandas()
    model.rate, model.scale = fit_extremes(null.most.to_numpy(float), np.maximum(null.words.to_numpy(float), 1.0))
    law = ToxicityModel(np.zeros(0), rate=model.rate, scale=model.scale)

    def condense(batches):
        for batch in batches:
            x = [surprise(law, n, np.array(sums)) for n, sums in zip(batch.column("words").to_pylist(), batch.column("sums").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], ["label", "strong", "many"])

    found = rows.select("label", "words", "sums").mapInArrow(condense, "label int, strong double, many double").limit(2 * train_rows).toPandas().sort_values(["label", "strong", "many"])
    model.slopes, model.offset = fit_link(np.log1p(found[["strong", "many"]].to_numpy(float)), found.label.clip(0, 1).to_numpy(float))
    discard(train, rows)
    return model


def fit_extremes(most: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Rate and scale of P(most > x) = 1 - exp(-scale * words * exp(-rate * x)), zeros being censored; maximum likelihood."""
    hit = most > 0
    n = hit.sum() + 0.5
    best = (-math.inf, 1.0, 1e-6)
    for rate in np.linspace(0.2, 3.0, 57):
        scale = n / max((words * np.exp(-rate * most)).sum(), 1.0)
        fit = n * (math.log(rate * scale) - 1) + np.log(words[hit]).sum() - rate * most[hit].sum()
        best = max(best, (fit, float(rate), float(scale)))
    return best[1], best[2]


def surprise(model: ToxicityModel, words: int, sums: np.ndarray) -> tuple[float, float]:
    """Of ``sums`` in descending order: the sum of -log E of the significant ones, and the most that the r largest surprise, for any r.

    Above the mean, r log(r / E) - r + E bounds -log P(Poisson(E) >= r).
    """
    if not len(sums):
        return 0.0, 0.0
    expected = np.log(model.scale * max(words, 1)) - model.rate * sums
    r = np.arange(1, len(sums) + 1)
    gain = r * (np.log(r) - expected) - r + np.exp(expected)
    return float(-expected[expected < math.log(E_LIMIT)].sum()), float(np.where(np.log(r) > expected, gain, 0.0).max())


def fit_link(z: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes (not below 0) and offset of a logistic curve, lightly penalised; a slope that would be negative is left out."""
    use = list(range(z.shape[1]))
    while True:
        x, w = np.column_stack([z[:, use], np.ones(len(z))]), np.zeros(len(use) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.01 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (p - y) + 0.01 * w)
            w = w - step / max(1.0, np.abs(step).max())
        if not use or w[:-1].min() >= 0:
            slopes = np.zeros(z.shape[1])
            slopes[use] = w[:-1]
            return tuple(slopes.tolist()), float(w[-1])
        use.pop(int(np.argmin(w[:-1])))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_passages`` (first word, last word, score, E-value of each significant one).

    Columns of those names are replaced, all others stay.  Null and empty texts have no passage and
    get the score of a document without one.  No row is shuffled.
    """
    base = docs.drop("toxicity", "toxic_passages")
    names = [f.name for f in base.schema.fields]
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        m = held.value
        for batch in slices(batches):
            scores, passages = [], []
            for n, found in _segments(m.scores, texts_of(batch)):
                strong, many = surprise(m, n, np.sort(np.array([s for *_, s in found]))[::-1])
                scores.append(1 / (1 + math.exp(-max(-700.0, m.slopes[0] * math.log1p(strong) + m.slopes[1] * math.log1p(many) + m.offset))))
                expected = [m.scale * max(n, 1) * math.exp(-m.rate * s) for *_, s in found]
                passages.append([{"first_word": a, "last_word": b, "score": s, "e_value": e} for (a, b, s), e in zip(found, expected) if e < E_LIMIT])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], [*names, "toxicity", "toxic_passages"])

    from pyspark.sql.types import StructType

    more = StructType.fromDDL("toxicity double, toxic_passages array<struct<first_word: long, last_word: long, score: double, e_value: double>>")
    return base.mapInArrow(run, StructType([*base.schema.fields, *more.fields]))
