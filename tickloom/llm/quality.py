"""Quality by attention-based multiple-instance learning (Ilse et al., 2018).

Every passage of a document is encoded (hashed words and word pairs, character classes, their
neighbours, repetition); gated attention weights, learned from document labels alone, make one
representation of the passages, which is scored.  The network is small and trained in numpy on a
bounded sample of labelled documents, all passages of each; encoding and scoring run over all
passages of all documents in Spark's tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LEAST_POWERS, bounded_labels, powers, slices, texts_of

PASSAGE_BYTES = 512
#: The network learns from whole labelled documents, in order of their id's hash: at most so many, with at most so many passages together.
TRAIN_ROWS, TRAIN_PASSAGES = 4_000, 40_000
HIDDEN, ATTENTION, EPOCHS = 16, 8, 60

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!", b"?", b"|", b"#$%&*", b"<>{}[]()=/\\_", b"\"':;-+@~^`"], 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 14
CLASSES = 15
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
#: Buckets of hashed words, and as many of pairs of neighbouring words.
WORD_BITS = 7
WORDS = 2**WORD_BITS
WIDTH = CLASSES + CLASSES * CLASSES + 2 * WORDS + 4
#: Weight decay by feature: hashed words and pairs are many, and weigh on the net only where they tell much.
DECAY = np.full((WIDTH, 1), 1e-4)
DECAY[CLASSES + CLASSES**2 : -4] = 1e-2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_buckets(data: np.ndarray, doc: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Share of each hashed word, and of each pair of neighbours, among the words that start in a passage."""
    out = np.zeros((total, 2 * WORDS), np.float32)
    inside = _IN_WORD[data]
    if not inside.any():
        return out
    turn = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(inside & np.concatenate([[True], turn]))
    ends = np.flatnonzero(inside & np.concatenate([turn, [True]])) + 1
    up, down = powers(max(LEAST_POWERS, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    word, at = _mixed((sums[ends] - sums[starts]) * down[starts]), passage[starts]
    near = doc[starts[1:]] == doc[starts[:-1]]
    pair = _mixed(word[:-1] * np.uint64(31) + word[1:])[near]
    drop = np.uint64(64 - WORD_BITS)
    out[:, :WORDS] = np.bincount(at * WORDS + (word >> drop).astype(np.int64), minlength=total * WORDS).reshape(total, WORDS)
    out[:, WORDS:] = np.bincount(at[:-1][near] * WORDS + (pair >> drop).astype(np.int64), minlength=total * WORDS).reshape(total, WORDS)
    return out / np.maximum(np.bincount(at, minlength=total), 1)[:, None].astype(np.float32)


def encode_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of each text in turn, and how many passages each text has (at least one)."""
    raw = [t.encode("utf-8") for t in texts]
    lens = np.array([len(r) for r in raw], np.int64)
    each = np.maximum(1, -(-lens // PASSAGE_BYTES))
    first = np.cumsum(each) - each
    total = int(each.sum())
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lens)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    passage = first[doc] + offset // PASSAGE_BYTES
    kind = _CLASS[data]
    out = np.zeros((total, WIDTH), np.float32)
    size = np.bincount(passage, minlength=total).astype(np.float32)
    per = np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / per
    if len(data) > 1:
        same = passage[1:] == passage[:-1]
        key = passage[1:][same] * CLASSES**2 + kind[:-1][same] * CLASSES + kind[1:][same]
        out[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(key, minlength=total * CLASSES**2).reshape(total, CLASSES**2) / per
    out[:, CLASSES + CLASSES**2 : -4] = word_buckets(data, doc, passage, total)
    # Repetition: share of a passage's 12-byte strings that stood earlier in the document.
    n = len(data) - 11
    if n > 0:
        value = np.zeros(n, np.uint64)
        for i in range(12):
            value = value * np.uint64(1_099_511_628_211) + data[i : i + n].astype(np.uint64)
        inside = doc[:n] == doc[11:]
        value = (value ^ (doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[inside]
        seen = np.ones(len(value), bool)
        seen[np.unique(value, return_index=True)[1]] = False
        out[:, -4] = np.bincount(passage[:n][inside], seen, minlength=total) / per[:, 0]
    out[:, -3] = size / PASSAGE_BYTES
    out[:, -2] = (np.repeat(lens, each) == 0).astype(np.float32)
    out[:, -1] = np.log1p(np.repeat(lens, each)) / 10
    return out, each


class MilNet:
    """Gated attention over encoded passages; parameters in a dict of arrays."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        shape = {"W": (len(mean), HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(max(s[0], 1) if s else 1), s) if len(s) else np.array(0.0) for k, s in shape.items()}
        self.p["b"] = np.zeros(HIDDEN)

    def forward(self, x: np.ndarray, each: np.ndarray):
        p, starts = self.p, np.cumsum(each) - each
        z = np.clip((x - self.mean) / self.std, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), each))
        a = e / np.repeat(np.add.reduceat(e, starts), each)
        m = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return s, (z, h, t, g, a, m)

    def gradients(self, x: np.ndarray, each: np.ndarray, y: np.ndarray) -> dict:
        s, (z, h, t, g, a, m) = self.forward(x, each)
        p, starts = self.p, np.cumsum(each) - each
        ds = (s - y) / len(y)
        dm = np.repeat(ds, each)[:, None] * p["c"]
        da = (dm * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), each))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dm + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": z.T @ dh + DECAY * p["W"], "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": m.T @ ds + 1e-4 * p["c"], "d": ds.sum()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        rng, step = np.random.default_rng(seed), 0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part, step = order[i : i + batch], step + 1
                grads = self.gradients(np.concatenate([bags[j] for j in part]), np.array([len(bags[j]) for j in part]), y[part])
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)


def fit_quality(docs: DataFrame, labels: DataFrame, *, column: str = "quality", train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES) -> MilNet:
    """Fit on at most ``train_rows`` labelled rows of the training fold, whole documents of at most ``train_passages`` passages together.

    Documents are taken in the order of their id's hash; one that doesn't fit any more is passed
    over, and where none fits this raises.  Without a labelled row the net is not trained, and its scores mean nothing.
    """
    # A bounded table (train_rows rows): broadcast.
    chosen = bounded_labels(labels, column, train_rows)
    longs = docs.select("doc_id", F.greatest(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE_BYTES), F.lit(1)).alias("passages"))
    sizes = longs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", F.xxhash64("doc_id").alias("h")).agg(F.sum("passages").alias("passages")).orderBy("h", "doc_id").collect()
    taken, room = [], train_passages
    for r in sizes:
        if r.passages <= room:
            taken.append((r.doc_id, r.label))
            room -= r.passages
    if sizes and not taken:
        raise ValueError(f"no labelled document has at most {train_passages} passages")
    kind = dict(docs.dtypes)["doc_id"]
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, label int"))

    def bags(batches):
        for batch in slices(batches):
            x, each = encode_passages(texts_of(batch))
            data = [part.astype("<f2").tobytes() for part in np.split(x, np.cumsum(each)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], ["doc_id", "label", "bag"])

    rows = docs.select("doc_id", "text").join(taken, "doc_id").select("doc_id", "text", "label").mapInArrow(bags, f"doc_id {kind}, label int, bag binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    x = [np.frombuffer(r.bag, "<f2").reshape(-1, WIDTH).astype(np.float32) for r in rows]
    y = np.array([min(max(r.label, 0), 1) for r in rows], float)
    if not x:
        return MilNet(np.zeros(WIDTH), np.ones(WIDTH))
    flat = np.concatenate(x)
    net = MilNet(flat.mean(0), flat.std(0) + 1e-3)
    net.fit(x, y)
    return net


def score_quality(docs: DataFrame, net: MilNet) -> DataFrame:
    """Add ``quality`` (0 to 1) and ``attention`` (largest passage weight); null and empty texts count as one empty passage.

    Columns of those names are replaced, all others stay.  No row is shuffled.
    """
    base = docs.drop("quality", "attention")
    names = [f.name for f in base.schema.fields]
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in slices(batches):
            x, each = encode_passages(texts_of(batch))
            s, parts = held.value.forward(x, each)
            most = np.maximum.reduceat(parts[4], np.cumsum(each) - each)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(most, pa.float64())], [*names, "quality", "attention"])

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType.fromDDL("quality double, attention double").fields]))
