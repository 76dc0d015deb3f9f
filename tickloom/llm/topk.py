"""Exact top-k search: tiles of queries times shards of candidates, merged as a tree.

Vectors become integers of the narrowest type that holds them; query blocks and candidate shards
meet in a grid of tiles, each a matrix product with a partial selection of k per query.  The tiles'
lists merge in two levels.  A shard is sent once to each query block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

QUERY_BLOCK, SHARD = 8_192, 4_096
#: Queries multiplied with a shard at once.
STRIP = 1_024
#: Lists merged at once: so many at least, and the square root of all shards where that is more, so that no merge of a query reads more.
FAN_IN = 16


def usable(column: str = "embedding") -> "F.Column":
    """Neither null nor holding null or non-finite components, and not of length zero."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _blocks(df: DataFrame, number: str, rows_in: str) -> DataFrame:
    """One row for each block: its vectors with their ids, in any order."""
    return df.groupBy(number).agg(F.collect_list(F.struct("vec_id", "v")).alias(rows_in))


def _narrowest(least: int | None, most: int | None) -> str:
    """The smallest integer type from ``least`` to ``most``."""
    bits = max((x if x >= 0 else ~x).bit_length() for x in (least or 0, most or 0))
    return "smallint" if bits < 16 else "int" if bits < 32 else "bigint"


def top_k(vectors: DataFrame, is_query: "F.Column", *, k: int = 10, scale: int = 1024, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of each query row.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Components become
    floor(scale * x).  Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; vectors of another length than the query's are no candidates.
    Rows that repeat exactly count once.  Where one id has several vectors, each is a candidate and
    the least is the query.  Ties go to the smaller vec_id.  Integer sums are exact below 2**63.
    """
    rows = stage(vectors.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct(), "integers")
    size = rows.agg(F.count("*").alias("all"), F.count_if(is_query).alias("queries"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most")).first()
    rows = rows.withColumn("v", F.col("v").cast(f"array<{_narrowest(size.least, size.most)}>"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    c, q = max(1, -(-size["all"] // shard)), max(1, -(-size.queries // query_block))
    shards = _blocks(rows.withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), F.lit(c))), "c", "candidates")
    blocks = _blocks(queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q))), "q", "queries")
    # A grid, not a product of rows: each block goes once to each tile of its row or column.
    left = blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1)).cast("array<bigint>")))
    right = shards.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1)).cast("array<bigint>")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("queries")[i].values, batch.column("candidates")[i].values
                out = [_tile(a, b, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)] + [pa.array([batch.column("c")[i].as_py()] * len(out[0][0]), pa.int64())], ["query_id", "vec_id", "score", "c"])

    tiles = left.join(right, ["q", "c"]).select("queries", "candidates", "c").mapInArrow(run, "query_id long, vec_id long, score long, c long")
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    merged = best(tiles.withColumn("part", F.floor(F.col("c") / max(FAN_IN, math.isqrt(c)))), "query_id", "part").drop("rank")
    return best(merged, "query_id").select("query_id", "rank", "vec_id", "score")


def _matrices(values) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of a block's vectors, by their length."""
    ids = np.asarray(values.field("vec_id"))
    lists = values.field("v")
    lens = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    starts = np.cumsum(lens) - lens
    return {int(n): (ids[lens == n], flat[(starts[lens == n][:, None] + np.arange(n))]) for n in np.unique(lens)}


def _tile(a, b, k: int):
    found = ([], [], [])
    right = _matrices(b)
    for n, (queries, x) in _matrices(a).items():
        if n not in right:
            continue
        ids, y = right[n]
        # Doubles hold the sums exactly below 2**53 and use fast products; beyond, integers.
        fx, fy = x.astype(np.float64), y.astype(np.float64)
        exact = np.abs(fx).max(initial=0) * np.abs(fy).max(initial=0) * n < 2**53
        if not exact:
            fx, fy = x.astype(np.int64), y.astype(np.int64)
        for i, query in enumerate(queries):
            if i % STRIP == 0:
                score = (fx[i : i + STRIP] @ fy.T).astype(np.int64)
            s, own = score[i % STRIP], ids != query
            s, d = s[own], ids[own]
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, d = s[keep], d[keep]
            order = np.lexsort((d, -s))[:k]
            found[0].append(np.full(len(order), query))
            found[1].append(d[order])
            found[2].append(s[order])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
