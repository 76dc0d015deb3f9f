"""Helpers shared by the operators: staging, batch slicing, fixed-size counters, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 500_000
COUNTERS_IN_CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders made inside each open :func:`staging`.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    return path


@contextlib.contextmanager
def staging(spark: SparkSession):
    """At its end, folders that operators staged inside are deleted: write or collect lazy results before."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]
        for path in paths:
            _delete(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote, once no later job reads it."""
    for df in staged:
        _delete(df.sparkSession, df.staged_at)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with every column but ``keep`` named by its number, so that none can clash with those added meanwhile; :func:`named` undoes it."""
    return docs.select(*(docs[c] if c in keep else docs[c].alias(f"numbered_{i}") for i, c in enumerate(docs.columns)))


def named(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*(F.col(c if c in keep else f"numbered_{i}").alias(c) for i, c in enumerate(columns)))


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and all columns as one struct: no name of ``docs`` can clash with those added meanwhile."""
    return docs.select(*keep, F.struct(*docs.columns).alias("packed_row"))


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns packed before, those in ``new`` replaced."""
    return df.select(*(new[c].alias(c) if c in new else F.col("packed_row")[c].alias(c) for c in columns))


#: Powers to begin with: enough for a slice.
LEAST_POWERS = 1 << 20


def slices(batches, column: str = "text", budget: int = SLICE_BYTES):
    """Cut Arrow batches into pieces of about ``budget`` bytes of ``column``; a longer value stands alone.

    When the batches end, memory that the worker no longer needs goes back to the machine.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1])
        group = np.cumsum(sizes, dtype=np.int64) // budget
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    give_back()


def give_back() -> None:
    """Free pages of this worker return to the machine, where its C library can do that: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(batch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def train_fold(doc_id) -> "F.Column":
    """True for rows labels may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def bounded_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` training labels (smallest id hashes): (doc_id, label), one for each id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & train_fold(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


_FACTOR = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of the factor and of its inverse, modulo 2**64; one pair of arrays is kept."""
    up, down = np.full(n, np.uint64(_FACTOR)), np.full(n, np.uint64(pow(_FACTOR, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


# ---------------------------------------------------------------- fixed-size counters


def counter_rows(counts: np.ndarray):
    """A (rows, width) array of counts as Arrow batches of compressed chunks that are not all zero."""
    slot, data = [], []
    flat = counts.reshape(-1, COUNTERS_IN_CHUNK)
    for i in np.flatnonzero(flat.any(axis=1)):
        slot.append(int(i))
        data.append(zlib.compress(flat[i].astype("<i8").tobytes(), 1))
    if slot:
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(data, pa.binary())], ["slot", "data"])


def merged_counters(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """Sum the chunks that tasks wrote; the result has a fixed size whatever the input's."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, d in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist()):
                counts = np.frombuffer(zlib.decompress(d), "<i8")
                total[s] = total[s] + counts if s in total else counts
        for s, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(counts.astype("<i8").tobytes(), 1)], pa.binary())], ["slot", "data"])

    out = np.zeros((rows * width // COUNTERS_IN_CHUNK, COUNTERS_IN_CHUNK), np.int64)
    for r in parts.repartition("slot").mapInArrow(add, "slot int, data binary").toLocalIterator():
        out[r.slot] += np.frombuffer(zlib.decompress(bytes(r.data)), "<i8")
    return out.reshape(rows, width)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): smallest id reachable, for every id that stands in an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Each round is written to
    the shared folder and the one before deleted; the number of rounds grows with the logarithm of
    the graph's diameter.  Repeated and self edges change nothing; without edges no id is returned.
    """
    pairs = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    known = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, stage(small.where("u <> v").distinct(), "edges")
        discard(last)
        seen = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen == known:
            break
        known = seen
    stars = pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
