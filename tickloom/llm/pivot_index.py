"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points in order.  Inverted lists hold the vectors of
each pivot; two vectors are candidates if they share enough pivots, and candidates are verified by
their cosine in double precision.  Reference points are chosen far apart.  Two lists of m pivots that share t have one in common among
the m - t + 1 rarest of each, so vectors are listed under those alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stage
from .topk import usable

#: Two vectors near each other share fewer of their nearest reference points the more there are: one
#: less is asked beyond SHARED_PIVOTS, and one less for each further factor of four.
SHARED_PIVOTS = 256
#: Reference points come from a bounded sample (vectors of smallest id hash: four for each point wanted, SAMPLE at most, or as many as
#: points wanted if that is more).  Their number grows with the square root of the input up to MOST_PIVOTS, or PIVOT_BYTES together: two
#: random vectors meet in a list about 80 times in as many pairs as there are points, so that work grows with the input to the power 1.5
#: up to a billion vectors of 64 components (110 million of 384), and with its square from there on.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, PIVOT_BYTES = 64, 65_536, 8_192, 1 << 26
#: No two reference points are as near as this: inside a dense group their order would be noise, and links would be lost.
APART = 0.85
NEAREST, SHARED = 12, 6
BLOCK = 512
#: Products of vectors and reference points held at once.
STRIP = 1 << 20


def shared_of(pivots: int, nearest: int = NEAREST, shared: int = SHARED) -> int:
    """How many of the nearest reference points a candidate pair shares, for so many reference points of its length."""
    fewer = max(0, math.ceil(math.log(pivots / SHARED_PIVOTS, 4))) if pivots else 0
    return max(1, min(shared - fewer, nearest, pivots))


def reference_points(x: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` rows of ``x`` (unit length), each the farthest from those before it, while that is farther than APART."""
    chosen, near = [], np.full(len(x), -2.0)
    while len(chosen) < wanted and near.min() < APART:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def nearest_points(x: np.ndarray, points: np.ndarray, nearest: int) -> np.ndarray:
    """The ``nearest`` rows of ``points`` for each row of ``x``, nearest first (ties: the smaller number); a strip of rows at a time."""
    k, out = min(nearest, len(points)), []
    for part in np.array_split(x, max(1, -(-x.shape[0] * len(points) // STRIP))):
        far = -(part @ points.T)
        some = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out)


def _unit(values) -> np.ndarray:
    x = np.asarray(values.flatten(), np.float64).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors, and what links them.

    Returns ``members`` (vec_id, label, cls; cls is the smallest vec_id with this vector and label)
    and ``links`` (a, b, n).  Rows with a b are a spanning forest of the links found in one tile of
    work (a and b are classes of cosine >= threshold); rows without b say that ``n`` vectors of other
    classes are linked to a by pairs of one tile.  Each pair belongs to one tile, that of its first
    common list, so the n of a class sum to its links, and a dense group isn't spelt out in pairs.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id or
    label, are in neither.  Vectors of different lengths never link.  Labels are of any type that can be grouped by.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    usual = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable() & F.exists("embedding", lambda x: x != 0)).select("vec_id", "label", v.alias("v"))
    firsts = usual.groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("m"))
    classes = stage(firsts, "vector-classes")
    members = usual.join(classes, ["label", "v"]).select("vec_id", "label", "cls")
    known = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("length")).first()
    n, most = known.n, min(MOST_PIVOTS, PIVOT_BYTES // (8 * (known.length or 1)))
    wanted = int(max(1, min(most, max(LEAST_PIVOTS, 2 * math.isqrt(n)))))
    # About as many rows as wanted have a small hash; each task sends its own, and the driver puts them in order.
    size = max(wanted, min(4 * wanted, SAMPLE))
    sample = classes.withColumn("h", F.pmod(F.xxhash64("cls", "label"), F.lit(max(n, 1)))).where(F.col("h") < size).toArrow().sort_by([("h", "ascending"), ("cls", "ascending"), ("label", "ascending")]).column("v").combine_chunks()
    lens = np.asarray(sample.value_lengths())
    pivots: dict[int, np.ndarray] = {}
    for size in np.unique(lens).tolist():
        own = sample.filter(pa.array(lens == size))
        pivots[size] = reference_points(_unit(own), max(1, round(wanted * len(own) / len(sample))))
    held = spark.sparkContext.broadcast(pivots)
    label = dict(classes.dtypes)["label"]

    def describe(batches):
        for batch in batches:
            lens = np.asarray(batch.column("v").value_lengths())
            for size in np.unique(lens).tolist():
                part = batch.filter(pa.array(lens == size))
                p = held.value.get(size)
                if p is None:  # no reference point of this length: one common list
                    lists = [[-1]] * part.num_rows
                else:
                    lists = nearest_points(_unit(part.column("v")), p, nearest).tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([size] * part.num_rows, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], [*part.schema.names, "size", "pivots"])

    described = stage(classes.select("cls", "label", "m", "v").mapInArrow(describe, f"cls long, label {label}, m long, v array<double>, size int, pivots array<int>"), "vector-pivots")
    need = {size: shared_of(len(p), nearest, shared) for size, p in pivots.items()}
    # Lists of pivots: a bounded table (at most MOST_PIVOTS), whose counts order the pivots from rare to common.
    counts = {r.pivot: r["count"] for r in described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()}
    place = spark.sparkContext.broadcast({p: i for i, p in enumerate(sorted(counts, key=lambda x: (counts[x], x)))})

    def post(batches):
        for batch in batches:
            lists = [sorted(map(place.value.__getitem__, p)) for p in batch.column("pivots").to_pylist()]
            short = [p[: max(1, len(p) - need.get(size, 1) + 1)] for p, size in zip(lists, batch.column("size").to_pylist())]
            kept = batch.drop_columns(["pivots"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(short, pa.list_(pa.int32()))], [*kept.schema.names, "pivots", "prefix"])

    # From here on pivots are numbered by that order.
    posts = described.mapInArrow(post, f"cls long, label {label}, m long, v array<double>, size int, pivots array<int>, prefix array<int>").select("*", F.explode("prefix").alias("pivot")).drop("prefix")
    posts = stage(posts, "vector-postings")
    # A long list is cut into blocks of about ``block`` vectors; pairs of blocks are the tiles of its work.
    keys = ["label", "size", "pivot"]
    lists = posts.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parts = posts.join(lists, keys).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")).groupBy(*keys, "blocks", "i").agg(F.collect_list(F.struct("cls", "m", "v", "pivots")).alias("rows"))
    parts = stage(parts, "vector-blocks")
    left = parts.select(*keys, "i", F.col("rows").alias("left"), F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"))
    right = parts.select(*keys, F.col("i").alias("j"), F.col("rows").alias("right"))

    def verify(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                same, size, pivot = batch.column("i")[k].as_py() == batch.column("j")[k].as_py(), batch.column("size")[k].as_py(), batch.column("pivot")[k].as_py()
                found = _verified(batch.column("left")[k].values, batch.column("right")[k].values, need.get(size, 1), pivot, threshold, same)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), from_pandas=True) for x in found], ["a", "b", "n"])

    links = left.join(right, [*keys, "j"]).select("left", "right", "size", "pivot", "i", "j").mapInArrow(verify, "a long, b long, n long")
    links = stage(links.groupBy("a", "b").agg(F.sum("n").alias("n")), "vector-links")
    discard(described, posts, parts)
    return members, links


def _verified(left, right, need: int, pivot: int, threshold: float, same: bool):
    """Rows (a, b, n) of a tile of the list of ``pivot``: a spanning forest of its links, then the links of each class."""
    x, y = _unit(left.field("v")), _unit(right.field("v"))
    a, b = np.asarray(left.field("cls")), np.asarray(right.field("cls"))
    p, q = (np.asarray(s.field("pivots").flatten()).reshape(len(s), -1) for s in (left, right))
    # How many lists come first in both: a pair that has an earlier one in common is another tile's.
    # (Prefixes start with the earliest, so an earlier common pivot stands in both prefixes.)
    kinds, at = np.unique(np.concatenate([p.ravel(), q.ravel()]), return_inverse=True)
    one, two = np.zeros((len(p), len(kinds)), np.float32), np.zeros((len(q), len(kinds)), np.float32)
    one[np.arange(len(p))[:, None], at[: p.size].reshape(p.shape)] = 1
    two[np.arange(len(q))[:, None], at[p.size :].reshape(q.shape)] = 1
    early = kinds < pivot
    hit = (one @ two.T >= need) & (one[:, early] @ two[:, early].T == 0) & (x @ y.T >= threshold)
    if same:
        hit &= a[:, None] < b[None, :]
    u, w = _forest(hit)
    counts = hit @ np.asarray(right.field("m")).astype(np.int64), np.asarray(left.field("m")).astype(np.int64) @ hit
    some = [np.flatnonzero(c) for c in counts]
    first = np.concatenate([np.minimum(a[u], b[w]), a[some[0]], b[some[1]]])
    second = np.ma.array(np.concatenate([np.maximum(a[u], b[w]), a[some[0]], b[some[1]]]), mask=np.arange(len(first)) >= len(u))
    return first, second, np.concatenate([np.zeros(len(u), np.int64), counts[0][some[0]], counts[1][some[1]]])


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of a spanning forest of the bipartite graph with these edges."""
    rows, columns = hit.any(axis=1), hit.any(axis=0)
    u, w = [], []
    while rows.any():
        seeds = [int(np.argmax(rows))]
        rows[seeds[0]] = False
        while seeds:
            i = seeds.pop()
            for j in np.flatnonzero(hit[i] & columns).tolist():
                columns[j] = False
                u.append(i)
                w.append(j)
                more = np.flatnonzero(hit[:, j] & rows)
                rows[more] = False
                u += more.tolist()
                w += [j] * len(more)
                seeds += more.tolist()
    return np.array(u, np.int64), np.array(w, np.int64)


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    n_links counts the other rows linked directly, equal vectors included.  A vector that takes no
    part has no link and is its own component; a row without an id has a null component and is kept.
    """
    members, links = near_vectors(vectors, **options)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    linked = links.where("b is null").select("a", F.col("n").alias("others"))
    groups = components(links.where("b is not null").select("a", "b"))
    classes = sizes.join(linked, sizes.cls == linked.a, "left").join(groups, sizes.cls == groups.id, "left")
    classes = classes.select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    found = members.select("vec_id", "cls").distinct().join(classes, "cls").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
