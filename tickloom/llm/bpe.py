"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words stand in one flat array.  In each round every word merges its
lowest-ranked pair; pairs are found by binary search over the sorted pair keys of the vocabulary,
and only the pairs beside a merge are looked up again.  A very long word has an array of its own,
linked in both directions, in which a round touches only the places of the pair that it merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

# The pre-tokenisation pattern that belongs to the published byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 150_000
#: A space beside other white space.
BESIDE = re.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] ")
NONE = np.int64(2**31 - 1)
#: Bytes of a word from which on it is merged by itself.
LONG = 1_024


def visible_bytes() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: itself, or a letter from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    hidden = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + hidden.index(b)) for b in range(256)}


class BpeCodec:
    """A vocabulary file of the tokenizers library, read for numpy; holds a bounded word cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        stand_in = visible_bytes()
        back = {c: b for b, c in stand_in.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = np.array([vocab[stand_in[b]] for b in range(256)], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made[order]
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, bytes] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it never merges) and the symbol it makes."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        for i, r in enumerate(raw):
            if len(r) > LONG:
                out[i], raw[i] = self._merge_long(self.first[np.frombuffer(r, np.uint8)]), b""
        lens = np.array([len(r) for r in raw], np.int64)
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        who = np.flatnonzero(lens)
        lens = lens[who]
        last = np.cumsum(lens) - 1
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._look_up(sym[:-1], sym[1:])
        if len(last):
            rank[last] = NONE
        while len(who):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                of_done = np.repeat(done, lens)
                ids, at = sym[of_done].astype("<u4").tobytes(), 0
                for w, n in zip(who[done].tolist(), lens[done].tolist()):
                    out[w] = ids[4 * at : 4 * (at + n)]
                    at += n
                keep = ~of_done
                sym, rank, made = sym[keep], rank[keep], made[keep]
                who, lens, best = who[~done], lens[~done], best[~done]
                if not len(who):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, lens))
            # In a run such as "aaaa" the same pair stands at neighbouring places: every second one merges.
            fresh = np.ones(len(hits), bool)
            fresh[1:] = np.diff(hits) != 1
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            sym[hits] = made[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            word = np.repeat(np.arange(len(who)), lens)
            lens = lens - np.bincount(word[hits], minlength=len(who))
            word, sym, rank, made = word[stay], sym[stay], rank[stay], made[stay]
            moved = hits - np.arange(len(hits))
            near = np.concatenate([moved, moved - 1])
            near = near[near >= 0]
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near], made[near] = self._look_up(sym[near], sym[near + 1])
        return out

    def _merge_long(self, start: np.ndarray) -> bytes:
        """Ids of one word: its pairs wait by rank, and each round merges those of the lowest, from the left.

        Time grows with n log n and the number of ranks met, memory is about 40 bytes a symbol.
        """
        n = len(start)
        sym = np.append(start, 0).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        rank, made, stay = np.full(n + 1, NONE, np.int32), np.zeros(n + 1, np.int32), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places, and let them wait."""
            rank[at] = NONE
            at = at[after[at] < n]
            rank[at], made[at] = self._look_up(sym[at].astype(np.int64), sym[after[at]].astype(np.int64))
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(part)

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            fresh = np.ones(len(at), bool)
            fresh[1:] = after[at[:-1]] != at[1:]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at], after[at], before[after[gone]] = made[at], after[gone], at
            rank[gone], stay[gone] = NONE, False
            look(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return sym[:n][stay].astype("<u4").tobytes()

    def words(self, text: str) -> list:
        """Pre-tokens of a text in order; a special token's id stands as an int."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        found: list = []
        for piece in self.cut.split(text):
            if piece in self.special:
                found.append(self.special[piece])
            else:
                found += self.pattern.findall(piece)
        return found

    def _ids(self, words: list) -> list[bytes]:
        """Ids of each pre-token; distinct ones are merged together."""
        known = dict.fromkeys(words)
        plain = [w for w in known if isinstance(w, str)]
        known.update(zip(plain, self.merge_words(plain)))
        known.update((w, np.array([w], "<u4").tobytes()) for w in known if not isinstance(w, str))
        return list(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Where single spaces alone part a text's pieces, no pre-token crosses them, so the ids of
        ``" piece"`` are kept; other texts are split as a whole.
        """
        if len(self.pieces) > CACHED_WORDS:
            self.pieces.clear()
        pieces, out = self.pieces, [b""] * len(texts)
        cut: dict[int, list[str]] = {}
        whole: dict[int, list] = {}
        for i, text in enumerate(texts):
            if text[:1].isspace() or text[-1:].isspace() or BESIDE.search(text) or any(s in text for s in self.special):
                whole[i] = self.words(text)
            elif text:
                cut[i] = text.split(" ")
                whole[i] = self.pattern.findall(cut[i][0])
        new = list({w for words in cut.values() for w in words[1:]}.difference(pieces))
        tokens = self.pattern.findall(" " + " ".join(new)) if new else []
        heads = [w[0] == " " for w in tokens]
        bounds = [*np.flatnonzero(heads).tolist(), len(tokens)]
        found = self._ids([*tokens, *(w for words in whole.values() for w in words)])
        pieces.update((w, b"".join(found[a:b])) for w, a, b in zip(new, bounds, bounds[1:]))
        at = len(tokens)
        for i, words in whole.items():
            out[i] = b"".join(found[at : at + len(words)])
            at += len(words)
        for i, words in cut.items():
            out[i] += b"".join(map(pieces.__getitem__, words[1:]))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec_of(path: str) -> BpeCodec:
    """One codec for each worker process, with its cache."""
    return BpeCodec(path)


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", *, decoded: bool = True) -> DataFrame:
    """Add ``ids`` (binary, little-endian uint32), ``n_tokens`` and, if asked, ``decoded`` text to ``docs``.

    Columns of the same names are replaced; all others stay.  A null text counts as empty: no ids,
    empty decoded text.  Rows that repeat are encoded one by one.  No row is shuffled.
    """
    base = docs.drop("ids", "n_tokens", "decoded")
    fields = [f.name for f in base.schema.fields]
    at = fields.index(next(f for f in fields if f.lower() == text.lower()))

    def run(batches):
        codec = codec_of(vocabulary)
        for batch in slices(batches, fields[at]):
            ids = codec.encode(texts_of(batch, fields[at]))
            more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            more += [pa.array([codec.decode(x) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*fields, "ids", "n_tokens", *["decoded"] * decoded])

    return base.mapInArrow(run, _schema(base, "ids binary, n_tokens long" + (", decoded string" if decoded else "")))


def _schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, from :func:`bpe_encode`."""
    made = bpe_encode(docs.select("doc_id", "text"), vocabulary)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
