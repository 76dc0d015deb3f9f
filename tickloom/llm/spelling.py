"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One edit changes a word's letter counts by a squared distance of 1 (a letter more or less) or 2 (a
letter for another), so a product of two blocks of letter counts, of words of one length and of
that length or one less, gives all candidates, which are then verified letter by letter.

An edit touches at most two letters.  With the letters dealt into three groups, the counts of one
group at least are the same in both words: blocks are of words with a length and a group's counts
in common, and a pair counts in the block of its first common group alone.  Blocks too large for
one task are cut into tiles, and every two tiles meet.  Nothing is capped; no pair leaves a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, slices, stage, texts_of

RUN, _GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
LETTERS, GROUPS = 26 + 64, 3
#: Characters of a text whose runs are listed at once.
PIECE_CHARS = 1 << 20
#: Runs counted by a task before it passes them on.
HELD_RUNS, HELD_CHARS = 200_000, 8_000_000
#: Words in a block, about; blocks beyond TILE words are cut into tiles of that size.
BLOCK, TILE = 1_024, 4_096
#: Distances looked at at once, and products of parts so small that their pairs are multiplied one by one instead.
STRIP, SMALL_PART = 1 << 20, 1_024
#: Blocks that need tiles are few: up to so many (about 4 MB) are broadcast, more are joined by shuffle.
BROADCAST_BLOCKS = 50_000


def word_counts(docs: DataFrame, *, least_letters: int = 5, least: int = 3, lose_every: int = 0) -> DataFrame:
    """word and n (occurrences in all texts) of words of at least ``least_letters`` code points seen ``least`` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased.
    ``lose_every`` k damages them first: where k divides the unsigned crc32 h of `<doc_id>:<word>`,
    code point h % length goes.  Null and empty texts have no words; a null doc_id is written as
    nothing; rows that repeat count each time; other columns are ignored; no row gives no word.
    """

    def count(batches):
        held: Counter = Counter()
        chars = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in _runs(text):
                    if len(run) < least_letters:
                        continue
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if lose_every:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % lose_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                    if word not in held:
                        chars += len(word)
                    held[word] += n
            if len(held) > HELD_RUNS or chars > HELD_CHARS:
                yield _counts(held)
                held, chars = Counter(), 0
        if held:
            yield _counts(held)
        give_back()

    rows = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _runs(text: str):
    """Runs of letters of a text and how often they stand, a piece of a long text at a time (a run may come again)."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield from Counter(RUN.findall(text, at, end)).items()
        at = end


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in one array (0 to 25 for a to z, then U+00C0 on), and the words' lengths."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(data < 128, data - ord("a"), data - 0xC0 + 26), np.array([len(w) for w in words], np.int64)


def letter_counts(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of letter counts for each word."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(at * LETTERS + letters, minlength=len(sizes) * LETTERS).reshape(-1, LETTERS)


_WEIGHT = np.random.default_rng(11).integers(1, 2**63, (2, LETTERS), dtype=np.uint64)


def group_keys(counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each group's counts; words that share the counts share the key."""
    return np.stack([counts[:, g::GROUPS].astype(np.uint64) @ _WEIGHT[0, g::GROUPS] for g in range(GROUPS)], axis=1)


def part_keys(counts: np.ndarray, group: int) -> np.ndarray:
    """For each third of the letters outside ``group``: a key of its counts and of the group's together."""
    at = np.arange(LETTERS)
    thirds = [(at % GROUPS != group) & (at // GROUPS % GROUPS == h) for h in range(GROUPS)]
    whole = counts[:, group::GROUPS].astype(np.uint64) @ _WEIGHT[0, group::GROUPS]
    return np.stack([whole * np.uint64(0x9E3779B97F4A7C15) + counts[:, t].astype(np.uint64) @ _WEIGHT[1, t] for t in thirds], axis=1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` (n, length) and ``b`` (n, length or one less) differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    m = b.shape[1]
    same = np.logical_and.accumulate(a[:, :m] == b, axis=1).sum(axis=1)
    rest = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
    return same + rest >= m


def near_in_tile(words: list[str], n: np.ndarray, shorter: np.ndarray, tile: np.ndarray, across: bool, group: int) -> tuple[np.ndarray, np.ndarray]:
    """How many near words each word meets here, and the place of the best one (-1: none).

    Words are those of one length, and those one shorter (``shorter``); of two tiles
    (``across``) only pairs of one word of each count.  A pair counts if ``group`` is the first group of letters whose counts it shares.
    The best near word has the largest n, and is the smallest in code-point order among equals.
    """
    letters, sizes = letters_of(words)
    counts = letter_counts(letters, sizes)
    keys = group_keys(counts)
    longest = int(sizes.max())
    # Products stay whole numbers: below 2**24 in single precision, 2**53 in double.
    x = counts.astype(np.float32 if longest <= 4_000 else np.float64 if longest <= 90_000_000 else np.int64)
    square = (x * x).sum(axis=1)
    starts = np.cumsum(sizes) - sizes
    near, total = np.zeros(len(words), np.int64), len(words)
    order = np.array(sorted(range(total), key=lambda i: (-n[i], words[i])), np.int64)
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    best = np.full(total, total, np.int64)

    parts = part_keys(counts, group)

    def met(rows: np.ndarray, columns: np.ndarray) -> None:
        for h in range(GROUPS):
            r, c = rows[np.argsort(parts[rows, h], kind="stable")], columns[np.argsort(parts[columns, h], kind="stable")]
            shared, first_r, n_r = np.unique(parts[r, h], return_index=True, return_counts=True)
            other, first_c, n_c = np.unique(parts[c, h], return_index=True, return_counts=True)
            _, at_r, at_c = np.intersect1d(shared, other, assume_unique=True, return_indices=True)
            first_r, n_r, first_c, n_c = first_r[at_r], n_r[at_r], first_c[at_c], n_c[at_c]
            pairs = n_r * n_c
            small = np.flatnonzero(pairs <= SMALL_PART)
            done = np.cumsum(pairs[small])
            for some in np.split(small, np.flatnonzero(np.diff(done * LETTERS // (4 * STRIP))) + 1):
                k = np.repeat(some, pairs[some])
                at = np.arange(len(k)) - np.repeat(np.cumsum(pairs[some]) - pairs[some], pairs[some])
                i, j = r[first_r[k] + at // n_c[k]], c[first_c[k] + at % n_c[k]]
                candidates(i, j, square[i] + square[j] - 2 * np.einsum("ij,ij->i", x[i], x[j]), h)
            for k in np.flatnonzero(pairs > SMALL_PART):
                mine, theirs = r[first_r[k] : first_r[k] + n_r[k]], c[first_c[k] : first_c[k] + n_c[k]]
                for strip in np.array_split(mine, -(-len(mine) * len(theirs) // STRIP)):
                    distance = square[strip][:, None] + square[theirs][None, :] - 2 * (x[strip] @ x[theirs].T)
                    i, j = np.nonzero((distance > 0) & (distance <= 2))
                    candidates(strip[i], theirs[j], distance[i, j], h)

    def candidates(i: np.ndarray, j: np.ndarray, distance: np.ndarray, h: int) -> None:
        ok = (distance > 0) & (distance <= 2)
        i, j = i[ok], j[ok]
        ok = (keys[i, group] == keys[j, group]) & (tile[i] != tile[j] if across else True)
        # A pair counts under the first group, and there under the first third, that it shares.
        for g in range(group):
            ok &= keys[i, g] != keys[j, g]
        for third in range(h):
            ok &= parts[i, third] != parts[j, third]
        # Of two words of one length, each pair once.
        ok &= (sizes[i] != sizes[j]) | (i < j)
        i, j = i[ok], j[ok]
        for k in np.array_split(np.arange(len(i)), max(1, len(i) * longest // (8 * STRIP))):
            if len(k):
                verified(i[k], j[k])

    def verified(i: np.ndarray, j: np.ndarray) -> None:
        a = letters[starts[i][:, None] + np.arange(sizes[i[0]])]
        b = letters[starts[j][:, None] + np.arange(sizes[j[0]])]
        ok = one_edit(a, b)
        for u, v in ((i[ok], j[ok]), (j[ok], i[ok])):
            near[:] += np.bincount(u, minlength=total)
            np.minimum.at(best, u, rank[v])

    own, less = np.flatnonzero(~shorter), np.flatnonzero(shorter)
    met(own, own)
    met(own, less)
    return near, np.where(best < total, order[np.minimum(best, total - 1)], -1)


def near_words(words: DataFrame, *, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """word, n_near (words exactly one edit away), best and best_n (that of largest n, ties: smallest), for words that have any.

    ``words`` has distinct words of the letters of :func:`word_counts`, and n; it is read twice.
    """
    spark = words.sparkSession
    # Blocks of one length and group share a number: as many as keep them near ``block`` words.
    cells = max(1, words.count() // (block * 8))

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column("word").to_pylist()
            letters, sizes = letters_of(text)
            keys = group_keys(letter_counts(letters, sizes))
            for g in range(GROUPS):
                cell = pa.array((keys[:, g] % np.uint64(cells)).astype(np.int64), pa.int64())
                for less in (False, True):
                    arrays = [pa.array(np.full(len(text), g), pa.int32()), pa.array(sizes + less, pa.int64()), cell, pa.array(np.full(len(text), less), pa.bool_()), batch.column("word"), batch.column("n")]
                    yield pa.RecordBatch.from_arrays(arrays, ["g", "size", "cell", "shorter", "word", "n"])

    rows = stage(words.select("word", "n").mapInArrow(keyed, "g int, size long, cell long, shorter boolean, word string, n long"), "spelling-blocks")
    place = ["g", "size", "cell"]
    large = stage(rows.groupBy(*place).agg(F.count("*").alias("words")).where(F.col("words") > 2 * tile).select(*place, F.ceil(F.col("words") / tile).cast("int").alias("tiles")), "spelling-large")
    few = large.count() <= BROADCAST_BLOCKS
    dealt = rows.join(F.broadcast(large) if few else large, place, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    # Each tile meets itself and every other one.
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*place, F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "tile", "shorter", "word", "n")

    def compare(part: pa.Table) -> pa.Table:
        words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
        near, best = near_in_tile(words, n, part.column("shorter").to_numpy(), part.column("tile").to_numpy(), part.column("a")[0] != part.column("b")[0], part.column("g")[0].as_py())
        found = np.flatnonzero(near)
        best_words = pa.array([words[i] for i in best[found]], pa.string())
        return pa.table({"word": pa.array([words[i] for i in found], pa.string()), "n_near": near[found], "best": best_words, "best_n": n[best[found]]})

    met = dealt.groupBy(*place, "a", "b").applyInArrow(compare, "word string, n_near long, best string, best_n long")
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("v"))
    out = stage(found.select("word", "n_near", F.col("v.best").alias("best"), (-F.col("v.m")).alias("best_n")), "spelling-near")
    discard(rows, large)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words and their forms: the last word reached by following forms.

    Each round follows twice as many forms as the one before; a form is seen at least twice as often
    as its word, so rounds grow with the logarithm of the logarithm of the largest n.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        longer = stage(links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(links)
        if not longer.where("moved").count():
            return longer.drop("moved")
        moved, links = longer, stage(longer.drop("moved"), "spelling-roots")
        discard(moved)


def group_variants(words: DataFrame, *, ratio: float = 2.0, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct words and their numbers n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at
    least ``ratio`` times its own, which must be over 1; else null.  root follows forms to the last
    word.  A word without near words has n_near 0, no form, and is its own root; no word gives no row.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms may run in a circle")
    known = stage(words.select("word", "n"), "spelling-words")
    near = near_words(known, block=block, tile=tile)
    joined = known.join(near, "word", "left")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "spelling-forms")
    discard(known, near)
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
