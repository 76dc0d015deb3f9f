"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal numbers of words are dealt to sources: the golden-ratio point of each slot falls in
the interval of one source's cumulative target.  The rank of a slot among its source's slots names
a block of the source's shuffled words, first to last and then again.  A source that has reached
its target gives up further slots; one that is short at the end gets closing slots.  DataFrame
functions only; running numbers come in two levels, so that no source is gathered into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stage, unpacked

BLOCK_WORDS = 4_096
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
CELLS = 4_096
CHUNK = 8_192
#: The golden ratio's fraction of 2**32.
GOLDEN = 2_654_435_769
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words; a null text has none) of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, n (1, 2, ... by code point, null last), weight, source_size and target of each source.

    ``weights`` repeat over the sources, which share ``total`` times all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight.  That is
    min(most * size, level * weight): sources are ordered by the level at which they fill up.
    One row for each source; the running sums over them are a small table.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by = by.withColumn("most", most * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "n")
    by = by.withColumn("all", total * F.sum("source_size").over(Window.partitionBy()))
    by = by.withColumn("filled", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # The level with the sources before this one full: the first source it doesn't fill has the final level.
    by = by.withColumn("level", (F.col("all") - F.col("filled")) / F.col("open"))
    free = by.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "n", "level"))).over(Window.partitionBy())["level"])
    return free.select("source", "n", "weight", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))).alias("target"))


def golden_point(i: "F.Column") -> "F.Column":
    """The 32-bit golden-ratio point of slot ``i``: i * GOLDEN modulo 2**32, without overflow."""
    low, high = F.pmod(i, F.lit(65_536)), F.pmod(F.floor(i / 65_536), F.lit(65_536))
    return F.pmod(F.pmod(high * GOLDEN, F.lit(65_536)) * 65_536 + low * GOLDEN, F.lit(2**32))


def schedule(goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, n (source), rank: which source each slot draws from, and its rank among the source's slots.

    Closing slots (of sources that the points left short) have numbers after all others.
    """
    goal, size = F.floor("target"), F.greatest("source_size", F.lit(1))
    # Whole laps take every block of the source, the last lap as many as it needs.
    goals = goals.withColumn("slots", (F.floor(goal / size) * F.ceil(size / block) + F.ceil(F.pmod(goal, size) / block)).cast("long"))
    total = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    count = math.ceil(total / block)
    before = F.coalesce(F.sum("target").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = goals.withColumn("lo", before).withColumn("hi", F.col("lo") + F.col("target"))
    point = lambda c: F.round(F.col(c) / F.lit(total or 1.0) * float(2**32)).cast("long")
    part = part.select("n", "slots", point("lo").alias("lo"), point("hi").alias("hi")).where("hi > lo")
    width = 2**32 // CELLS
    cells = part.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slots = goals.sparkSession.range(count).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    dealt = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "n", "slots", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    # Ranks in two levels: by chunk of slots, then within it.
    sums = dealt.groupBy("n", "chunk").agg(F.count("*").alias("c"))
    sums = sums.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.join(sums, ["n", "chunk"]).select("slot", "n", "slots", (F.col("before") + F.row_number().over(Window.partitionBy("n", "chunk").orderBy("slot")) - 1).alias("rank"))
    had = sums.groupBy("n").agg(F.sum("c").alias("had"))
    short = goals.join(had, "n", "left").where(F.col("slots") > F.coalesce("had", F.lit(0)))
    closing = short.select("n", F.explode(F.sequence(F.coalesce("had", F.lit(0)).cast("long"), F.col("slots") - 1)).alias("rank")).select((F.lit(count) + F.col("rank") * F.lit(1_000_003) + F.col("n")).alias("slot"), "n", "rank")
    return ranked.where("rank < slots").select("slot", "n", "rank").union(closing)


def placed(sizes: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, size, and the words [first, last) that the row holds of its source's shuffled words.

    The order is that of md5 of the seed and the id; equal ids stand by size.  Running sums come in
    two levels, by 4,096 parts of the hash.
    """
    mixed = sizes.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))).withColumn("part", F.substring("h", 1, 3))
    sums = mixed.groupBy("source", "part").agg(F.sum("size").alias("c"))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = mixed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    last = F.col("before") + F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return at.select("doc_id", "source", "size", (last - F.col("size")).alias("first"), last.alias("last"))


def mix(docs: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK_WORDS, seed: str = "") -> tuple[DataFrame, DataFrame]:
    """Mix all rows of ``docs``; returns ``rows`` and ``pieces``.

    ``rows``: doc_id, source, size, source_size, target and taken (words the mix takes, repeats
    counted) of every row.  ``pieces``: slot, doc_id, source and words [first, last) of the row that
    each slot draws.  A source takes its target rounded down; no row is taken more than twice
    (``most`` is at most 2).  Empty rows take nothing.  Equal rows are placed one after another.
    """
    sizes = stage(sized(docs), "mix-sizes")
    goals = stage(targets(sizes, weights, total, most), "mix-targets")
    place = stage(placed(sizes, seed), "mix-places")
    # Block b of a source is words [b * block, (b + 1) * block) of it, the last one being shorter.
    facts = goals.select("n", "source", "source_size", F.floor("target").alias("goal"), F.ceil(F.col("source_size") / block).alias("blocks"))
    slots = schedule(goals, block).join(facts.drop("source"), "n").withColumn("b", F.pmod("rank", "blocks")).withColumn("lap", F.floor(F.col("rank") / F.col("blocks")))
    slots = slots.select("slot", "n", "b", "lap", (F.col("b") * block).alias("from"), F.least((F.col("b") + 1) * block, "source_size", F.col("goal") - F.col("lap") * F.col("source_size")).alias("to")).where("`to` > `from`")
    rows = place.join(facts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
    spread = rows.select("doc_id", "source", "n", "size", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))).alias("b"))
    drawn = spread.join(slots, ["n", "b"]).select("slot", "doc_id", "source", "n", "size", F.col("first").alias("at"), F.greatest("first", "from").alias("lo"), F.least("last", "to").alias("hi")).where("hi > lo")
    pieces = drawn.select("slot", "doc_id", "source", "at", "size", (F.col("lo") - F.col("at")).alias("first"), (F.col("hi") - F.col("at")).alias("last"))
    taken = drawn.groupBy("n", F.col("at").alias("t_at")).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).withColumnRenamed("n", "t_n")
    # A row of at least one word is alone at its place.
    out = place.join(goals.select(F.col("source").alias("s"), "n", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    out = out.join(taken, (F.col("n") == F.col("t_n")) & (F.col("first") == F.col("t_at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")), pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as its words are taken (rounded to 0, 1 or 2 times)."""
    rows, _ = mix(docs, **options)
    times = rows.groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("k"))
    times = times.select(F.col("doc_id").alias("m_id"), F.col("size").alias("m_size"), F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / (F.col("size") * F.col("k")))).cast("int").alias("times"))
    own = packed(docs, "doc_id", "text").withColumn("m_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    kept = own.join(times, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("m_words") == F.col("m_size"))).where("times > 0")
    return unpacked(kept.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)
