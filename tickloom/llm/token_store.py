"""Token-id store: one zstandard frame for each document, a shared dictionary, an offset index.

Layout under a path: ``dictionary`` (one row: bytes, sha256, tokenizer's sha256, id width) and
``blocks`` (Parquet rows in document order; each holds the frames of consecutive documents in
``payload`` beside ``doc_ids``, ``n_tokens`` and ``offsets``, the hash of the dictionary and the
place of its first id within its shard).  A document is read with one slice of a payload.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import visible_bytes
from .common import slices, texts_of

END_ID = 2
LEVEL = 3
DICTIONARY_BYTES = 65_536
#: The dictionary is trained on pieces of so many bytes of the ids of about so many documents (small id hashes), whole ones; of at most so many pieces, those of smallest hash.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, SAMPLE_PIECES = 1_000, 8_192, 2_000
BLOCK_BYTES = 1_000_000
#: Once known stems are more than so many, or hold more than so many ids, those not met again are forgotten; pre-tokens of mixed words up to so many characters are kept, so many of them.
CACHED_WORDS, CACHED_IDS = 700_000, 4_000_000
PIECE_CHARACTERS, CACHED_PIECES = 64, 65_536
#: So many bytes of text are split into words at once: each distinct stem of them is looked up once.
SLICE_BYTES = 8_000_000
#: The pre-tokens of the vocabulary file whose words are told apart here; with any other, texts go to the library whole.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which every Unicode version agrees about letters, numbers and lower case (no capital sigma).
SETTLED = re.compile(r"[\t-\r\x20-\x7e\x85\xa0-\u024f\u0391-\u03a1\u03b1-\u03c9\u0400-\u045f\u2000-\u206f\u20ac\u3000-\u3029\u3041-\u3094\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]*")


class WordEncoder:
    """Encodes whole texts with the tokenizers library, asking its model once for each distinct stem.

    A text of settled characters is normalised as the file says (NFC, lower case), split at white
    space, which no pre-token spans, and letters before closing ASCII punctuation are told apart
    from it, as pre-tokens are; what is new goes to the library's model, pre-token by pre-token.
    Other texts, and those that hold special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split == {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}
        self.pattern = regex.compile(PRE_TOKENS)
        self.model = self.tokenizer.model
        self.again = functools.lru_cache(CACHED_PIECES)(self._piece)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.stand_in = visible_bytes() | {ord("\n"): "\n"}
        self.forget()

    def forget(self) -> None:
        """``cache`` tells the row of a known stem: its ids are ``ids[stops[row] : stops[row + 1]]``."""
        self.cache: dict[str, int] = {}
        self.ids, self.stops, self.met = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def _trim(self) -> None:
        """Stems that were met again since they were learned, or since the last trim, stay known; where those fill half the bound, none does."""
        kept = np.flatnonzero(self.met)
        sizes = np.diff(self.stops)[kept]
        ids, stems = _gathered(self.ids, self.stops[kept], sizes), list(itertools.compress(self.cache, self.met.tolist()))
        self.forget()
        if len(stems) <= CACHED_WORDS // 2 and len(ids) <= CACHED_IDS // 2:
            self.cache.update(zip(stems, range(len(stems))))
            self.ids, self.stops, self.met = ids, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(stems), bool)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, its bytes written as their stand-ins."""
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self, words: pa.Array) -> None:
        """Ids of stems without white space; letters alone are one pre-token."""
        texts = _listed(words)
        shown = "\n".join(texts).encode().decode("latin-1").translate(self.stand_in).split("\n")
        ids, ends = [], []
        for text, word, letters in zip(texts, shown, _listed(pc.utf8_is_alpha(words))):
            if letters:
                ids += self._piece(word)
            else:
                for piece in self.pattern.findall(text):
                    ask = self.again if len(piece) <= PIECE_CHARACTERS else self._piece
                    ids += ask("".join(map(self.stand_in.__getitem__, piece.encode())))
            ends.append(len(ids))
        first = len(self.stops) - 1
        self.cache.update(zip(texts, range(first, first + len(texts))))
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.array(ends, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, "<u4")])
        self.met = np.concatenate([self.met, np.zeros(len(texts), bool)])

    def _rows(self, stems: pa.Array) -> np.ndarray:
        """Rows of distinct stems, new ones learned."""
        rows = np.fromiter(map(self.cache.get, _listed(stems), itertools.repeat(-1)), np.int64, len(stems))
        self.met[rows[rows >= 0]] = True
        new = np.flatnonzero(rows < 0)
        rows[new] = np.arange(len(new)) + len(self.stops) - 1
        if len(new):
            self._learn(stems.take(pa.array(new)))
        return rows

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        if len(self.cache) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self._trim()
        whole, plain, settled = [], [], []
        for i, text in enumerate(texts):
            if not self.plain or not SETTLED.fullmatch(text) or any(s in text for s in self.special):
                whole.append(i)
            else:
                plain.append(i)
                settled.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        # Words are split and told apart by Arrow; only distinct stems are Python's.
        split = pc.utf8_split_whitespace(pa.array(settled, pa.large_string()))
        words = split.flatten().dictionary_encode()
        stems = _stems(words.dictionary).dictionary_encode()
        rows = self._rows(stems.dictionary)[stems.indices.to_numpy()]
        n = np.diff(self.stops)[rows]
        ids = _gathered(self.ids, self.stops[rows], n)
        n, places = n.reshape(-1, 2).sum(axis=1), words.indices.to_numpy()
        counts = n[places]
        data = _gathered(ids, (np.cumsum(n) - n)[places], counts).tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(counts)])[split.offsets.to_numpy()]).tolist()
        for i, a, b in zip(plain, cuts, cuts[1:]):
            out[i] = data[a:b]
        for i, ids in zip(whole, self._ask([texts[i] for i in whole])):
            out[i] = ids
        return out


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _stems(words: pa.Array) -> pa.Array:
    """Each word as two values: its letters and the ASCII punctuation behind them, or all of it and nothing."""
    stems, sizes = pc.utf8_rtrim(words, characters=string.punctuation), pc.binary_length(words).to_numpy()
    letters = np.where(pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False), pc.binary_length(stems).to_numpy(), sizes)
    stops = np.concatenate([[0], np.cumsum(np.stack([letters, sizes - letters], axis=1), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(stops), words.buffers()[2])


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of so many ids from each start on, one behind the other."""
    stops = np.concatenate([[0], np.cumsum(counts)])
    return ids[np.repeat(starts - stops[:-1], counts) + np.arange(stops[-1])]


@functools.lru_cache(2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, with its cache."""
    return WordEncoder(path)


def _narrow(ids: bytes) -> bytes:
    """A width byte (2 or 4) and the ids at that width."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if len(a) and a.max() < 65_536 else b"\x04" + ids


def _wide(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"\x02" else data[1:]


def train_dictionary(samples: list[bytes]) -> bytes:
    """Bytes of a dictionary trained on serialised ids; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode the whole text of every row, append id 2, and write the store at ``path``.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text is empty (its ids are
    the end id alone).  Documents stand in ascending doc_id order, a null id first; rows that share
    an id stand side by side, each with its own frame.
    """
    spark = docs.sparkSession
    end = np.array([END_ID], "<u4").tobytes()

    def sample(batches):
        encoder = encoder_of(tokenizer)
        for batch in slices(batches, budget=SLICE_BYTES):
            ids = map(_narrow, (x + end for x in encoder.encode(texts_of(batch))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + SAMPLE_BYTES] for x in ids for i in range(0, len(x), SAMPLE_BYTES)], pa.binary())], ["ids"])

    total = F.lit(max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), total) < SAMPLE_DOCUMENTS).select("text")
    samples = [bytes(r.ids) for r in picked.mapInArrow(sample, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(SAMPLE_PIECES).collect()]
    dictionary = train_dictionary(sorted(samples))
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha, tokenizer.rpartition("/")[2])], "dictionary binary, sha256 string, tokenizer string").write.parquet(f"{path}/dictionary")

    def run(batches):
        encoder, shard, place = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        ids, counts, offsets, payload, first, block = [], [], [0], [], 0, 0

        def flush():
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "dictionary_sha256": sha, "first_place": first, "doc_ids": ids, "n_tokens": counts, "offsets": offsets, "payload": b"".join(payload)}], schema=BLOCK)

        for batch in slices(batches, budget=SLICE_BYTES):
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                found += end
                frame = packer.compress(_narrow(found))
                ids.append(doc)
                counts.append(len(found) // 4)
                payload.append(frame)
                offsets.append(offsets[-1] + len(frame))
                place += len(found) // 4
                if offsets[-1] >= BLOCK_BYTES:
                    yield flush()
                    ids, counts, offsets, payload, first, block = [], [], [0], [], place, block + 1
        if ids:
            yield flush()

    BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("first_place", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, "shard int, block int, dictionary_sha256 string, first_place long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError(f"{path}: the dictionary does not have the hash that the store names")
    return data, row.sha256


def unpack(dictionary: bytes, frame: bytes) -> bytes:
    """Ids of one document, little-endian uint32, from its frame."""
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    return _wide(reader.decompress(frame))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of every row stored under one id, by the offset index: only its frames are unpacked."""
    dictionary, _ = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id))
    hits = blocks.select(F.expr("filter(transform(doc_ids, (d, i) -> struct(d as d, offsets[i] as a, offsets[i + 1] as b)), x -> x.d = " + str(int(doc_id)) + ")").alias("x"), "payload")
    frames = hits.select(F.explode("x").alias("x"), "payload").select(F.expr("substring(payload, cast(x.a + 1 as int), cast(x.b - x.a as int))").alias("frame"))
    return [np.frombuffer(unpack(dictionary, bytes(r.frame)), "<u4").tolist() for r in frames.collect()]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary) of every document in the store."""
    dictionary, sha = read_dictionary(spark, path)

    def run(batches):
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                ids = [_wide(reader.decompress(row["payload"][a:b])) for a, b in zip(row["offsets"], row["offsets"][1:])]
                n = [len(x) // 4 for x in ids]
                if n != row["n_tokens"]:
                    raise ValueError("the index does not agree with the frames")
                place = row["first_place"] + np.cumsum([0, *n[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["shard", "doc_id", "place", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(run, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    # One row for each shard (a task of the writer): the running total over them is a small table.
    shards = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)")).alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids")
