"""Conversation structure repair: the cheapest edits that leave turns in order, by a parallel Viterbi over chunks.

Role initials must spell `(s?(ua)+)?`; a row is kept, given another role or deleted, and turns are
inserted.  Costs to go are computed backward.  A conversation is cut into chunks of rows that start
from speculative cost vectors; fix-up passes hand each chunk the vector its successor found and
rerun it until the old and the new vectors differ only by a constant, which changes no decision
before that row (rank convergence; Maleki, Musuvathi and Mytkowicz, 2014).  Stretches that never
converge, such as long runs of rows that are all deleted, would need a pass for each chunk: what is
open after FIXUPS passes is carried by the chunks' cost matrices, right to left, one small row for
each chunk.  Then the chunks' maps of states are stitched and every chunk traces its own edits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, stage

SPACE = r"\x20\x09-\x0D"
#: Costs of the edits, and what a truncated row adds that isn't deleted.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CHUNK_BITS, FIXUPS = 12, 3
#: Rows whose vectors a task holds at once.
STRIP = 400_000
#: States: nothing yet, after s, after u, after a.  Where an inserted or renamed turn leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GIVEN = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
INITIALS = "sua"
FAR = 1 << 40
#: Place of what is inserted after a conversation's last row.
LAST_PLACE = 1 << 62

# ---------------------------------------------------------------- costs

_ENTER = np.full((4, 4), -1)  # state after keeping a row: by state and initial (s, u, a, other)
_ENTER[START, 0] = AFTER_S
_ENTER[[START, AFTER_S, AFTER_A], 1] = AFTER_U
_ENTER[AFTER_U, 2] = AFTER_A


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost matrices by code (initial * 2 + truncated), insertions before the row included; and the costs at the end, by state."""
    insert = np.where(np.eye(4, dtype=bool), 0, FAR)
    insert[np.arange(4), GIVEN] = INSERT
    closure = _min_plus(_min_plus(insert, insert), insert)
    whole = np.full((8, 4, 4), FAR)
    for code in range(8):
        more = TRUNCATED * (code % 2)
        edit = np.where(np.eye(4, dtype=bool), DELETE, FAR)
        for s in range(4):
            edit[s, GIVEN[s]] = min(edit[s, GIVEN[s]], RENAME + more)
            to = _ENTER[s, code // 2]
            if to >= 0:
                edit[s, to] = min(edit[s, to], more)
        whole[code] = _min_plus(closure, edit)
    done = np.where(np.isin(np.arange(4), [START, AFTER_A]), 0, FAR)
    return whole, (closure + done[None, :]).min(axis=1)


MATRIX, END = _tables()


def normal(v: np.ndarray) -> np.ndarray:
    """Vectors without their constant: those that differ by a constant become equal."""
    return v - v.min(axis=-1, keepdims=True)


def _by_length(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks by falling length, and how many of them have more than r rows, for each r."""
    order = np.argsort(-sizes, kind="stable")
    longer = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")
    return order, longer


def backward(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go before and after each row of chunks that lie one after another, and at each chunk's start."""
    starts = np.cumsum(sizes) - sizes
    before, after = np.empty((len(codes), 4), np.int64), np.empty((len(codes), 4), np.int64)
    order, longer = _by_length(sizes)
    v = ends[order].astype(np.int64)
    for r, k in enumerate(longer):
        at = (starts + sizes)[order[:k]] - 1 - r
        after[at] = v[:k]
        v[:k] = (MATRIX[codes[at]] + v[:k, None, :]).min(axis=2)
        before[at] = v[:k]
    out = np.empty_like(v)
    out[order] = v
    return before, after, out


def fixed_up(codes: np.ndarray, sizes: np.ndarray, old: np.ndarray, new: np.ndarray, old_start: np.ndarray) -> np.ndarray:
    """Start vectors (without their constants) of chunks whose end vectors changed from ``old`` to ``new``.

    Both run backward side by side; where they differ only by a constant the old start stands.
    """
    starts = np.cumsum(sizes) - sizes
    out = normal(old_start).astype(np.int64)
    open_ = np.flatnonzero((normal(old) != normal(new)).any(axis=1))
    a, b, r = old[open_].astype(np.int64), new[open_].astype(np.int64), 0
    while len(open_):
        ended = sizes[open_] <= r
        out[open_[ended]] = normal(b[ended])
        same = (normal(a) == normal(b)).all(axis=1)
        go = ~ended & ~same
        open_, a, b = open_[go], a[go], b[go]
        m = MATRIX[codes[(starts + sizes)[open_] - 1 - r]]
        a, b, r = (m + a[:, None, :]).min(axis=2), (m + b[:, None, :]).min(axis=2), r + 1
    return out


def decisions(codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and state: number of insertions before it, edit (0 D, 1 K, 2 R) and state after it, of the ASCII-least cheapest edits."""
    more, rows = TRUNCATED * (codes % 2), np.arange(len(codes))
    choice, to = np.empty((len(codes), 4), np.int8), np.empty((len(codes), 4), np.int8)
    for s in range(4):
        enter = _ENTER[s][codes // 2]
        keep = np.where(enter >= 0, more + after[rows, enter], FAR)
        d, i = DELETE + after[:, s] == before[:, s], INSERT + before[:, GIVEN[s]] == before[:, s]
        # D < I < K < R.
        choice[:, s] = np.select([d, i, keep == before[:, s]], [0, 3, 1], 2)
        to[:, s] = np.select([choice[:, s] == 0, choice[:, s] == 1], [s, enter], GIVEN[s])
    count, state = np.zeros((len(codes), 4), np.int8), np.tile(np.arange(4), (len(codes), 1))
    for _ in range(3):
        more_i = choice[rows[:, None], state] == 3
        count += more_i
        state = np.where(more_i, GIVEN[state], state)
    return count, choice[rows[:, None], state], to[rows[:, None], state]


def walk(sizes: np.ndarray, to: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each row and after each chunk, from the chunks' entry states."""
    starts = np.cumsum(sizes) - sizes
    order, longer = _by_length(sizes)
    state, out = entry[order].astype(np.int64), np.empty(len(to), np.int64)
    for r, k in enumerate(longer):
        at = starts[order[:k]] + r
        out[at] = state[:k]
        state[:k] = to[at, state[:k]]
    last = np.empty_like(state)
    last[order] = state
    return out, last


# ---------------------------------------------------------------- rows and chunks


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text in order: place, copies (equal rows after this one), blank, truncated, initial and key.

    Order is by conversation, turn (nulls first), role and text; null roles and texts are one space.
    Equal rows become one row, so that no group of them meets in one task.
    """
    space = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    one = rows.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg((F.count("*") - 1).alias("copies"))
    order = ["conv_id", "turn", "role", "text"]
    # Ranges need no more of a text than its first characters: whole texts would travel to the driver in their sample.
    one = one.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    key = F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256), F.col("text")).cast("binary"), 256)
    return one.select(*order, "copies", "place", (last == "").alias("blank"), (~last.isin(".", "!", "?", "")).alias("truncated"), number.alias("initial"), key.alias("key"))


def _strips(batch, *columns: str):
    """A batch of chunks cut to STRIP rows: (batch, codes, sizes, arrays of the other list columns with four values a chunk)."""
    sizes = np.asarray(batch.column("codes").value_lengths(), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // STRIP)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            fours = [np.array(part.column(c).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, 4) for c in columns]
            yield part, part.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes[a:b], *fours


def _fours(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


def _settled(chunks: DataFrame, fixups: int) -> DataFrame:
    """id and end (cost vector after the chunk's last row, without its constant) of chunks (conv_id, id, next, codes)."""
    columns = "id long, next long, end array<long>, start array<long>"

    def speculative(batches):
        for batch in batches:
            for part, codes, sizes in _strips(batch):
                ends = np.tile(normal(END), (len(sizes), 1))
                _, _, start = backward(codes, sizes, ends)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("next"), _fours(ends), _fours(normal(start))], ["id", "next", "end", "start"])

    def rerun(batches):
        for batch in batches:
            for part, codes, sizes, old, start, new in _strips(batch, "end", "start", "new_end"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("next"), _fours(new), _fours(fixed_up(codes, sizes, old, new, start))], ["id", "next", "end", "start"])

    v = stage(chunks.select("id", "next", "codes").mapInArrow(speculative, columns), "repair-vectors")
    for _ in range(fixups):
        ahead = v.select(F.col("id").alias("ahead"), F.col("start").alias("new_end"))
        changed = stage(v.join(ahead, F.col("next") == F.col("ahead")).where("end <> new_end").drop("ahead"), "repair-changed")
        if not changed.count():
            discard(changed)
            return v.select("id", "end")
        fixed = changed.join(chunks.select("id", "codes"), "id").mapInArrow(rerun, columns)
        last, v = v, stage(fixed.unionByName(v.join(changed.select("id"), "id", "left_anti")), "repair-vectors")
        discard(last, changed)
    discard(v)

    def matrices(batches):
        for batch in batches:
            for part, codes, sizes in _strips(batch):
                # The four unit vectors give the chunk's matrix.
                units = [backward(codes, sizes, np.tile(np.where(np.arange(4) == s, 0, FAR), (len(sizes), 1)))[2] for s in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("id"), pa.array(np.minimum(np.stack(units, axis=2), FAR).reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["conv_id", "id", "m"])

    def carried(batches):
        conv, vector = object(), END
        for batch in batches:
            ends = []
            for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("m").to_pylist()):
                if c != conv:
                    conv, vector = c, END
                ends.append(normal(vector).tolist())
                vector = (np.array(m).reshape(4, 4) + vector[None, :]).min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ends, pa.list_(pa.int64()))], ["id", "end"])

    kind = dict(chunks.dtypes)["conv_id"]
    m = chunks.select("conv_id", "id", "codes").mapInArrow(matrices, f"conv_id {kind}, id long, m array<long>")
    return m.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("id")).mapInArrow(carried, "id long, end array<long>")


def _entries(chunks: DataFrame) -> DataFrame:
    """id and entry (state before the chunk's first row) of chunks (conv_id, id, codes, end)."""

    def maps(batches):
        for batch in batches:
            for part, codes, sizes, ends in _strips(batch, "end"):
                before, after, _ = backward(codes, sizes, ends)
                _, _, to = decisions(codes, before, after)
                leads = np.stack([walk(sizes, to, np.full(len(sizes), s))[1] for s in range(4)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("id"), _fours(leads)], ["conv_id", "id", "leads"])

    def stitched(batches):
        conv, state = object(), START
        for batch in batches:
            entry = []
            for c, leads in zip(batch.column("conv_id").to_pylist(), batch.column("leads").to_pylist()):
                if c != conv:
                    conv, state = c, START
                entry.append(state)
                state = leads[state]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(entry, pa.int64())], ["id", "entry"])

    kind = dict(chunks.dtypes)["conv_id"]
    m = chunks.select("conv_id", "id", "codes", "end").mapInArrow(maps, f"conv_id {kind}, id long, leads array<long>")
    return m.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(stitched, "id long, entry long")


def _traced(batches):
    """Edits of each chunk's rows, and what is inserted after a conversation's last row."""
    for batch in batches:
        for part, codes, sizes, ends in _strips(batch, "end"):
            before, after, _ = backward(codes, sizes, ends)
            count, edit, to = decisions(codes, before, after)
            state, last = walk(sizes, to, part.column("entry").to_numpy())
            rows = np.arange(len(codes))
            n, e = count[rows, state], edit[rows, state]
            inserted, at = np.full(len(rows), "", object), state.copy()
            for k in range(int(n.max(initial=0))):
                turn = np.where(GIVEN[at] == AFTER_U, "u", "a")
                inserted = np.where(n > k, inserted + turn.astype(object), inserted)
                at = np.where(n > k, GIVEN[at], at)
            role = np.where(e == 2, np.where(GIVEN[at] == AFTER_U, "user", "assistant"), None)
            conv = part.column("conv_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            place = np.repeat(part.column("id").to_numpy(), sizes) + part.column("offsets").flatten().to_numpy(zero_copy_only=False)
            yield _edits(conv, pa.array(place, pa.int64()), inserted.tolist(), np.array(["D", "K", "R"], object)[e].tolist(), role.tolist())
            closing = [["", "ua", "a", ""][s] for s in last]
            some = [i for i, (x, final) in enumerate(zip(closing, part.column("final").to_pylist())) if x and final]
            if some:
                yield _edits(part.column("conv_id").take(pa.array(some, pa.int64())), pa.array([LAST_PLACE] * len(some), pa.int64()), [closing[i] for i in some], [""] * len(some), [None] * len(some))


def _edits(conv, place, inserted: list, edit: list, role: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([conv, place, pa.array(inserted, pa.string()), pa.array(edit, pa.string()), pa.array(role, pa.string())], ["conv_id", "place", "inserted", "edit", "given_role"])


def repair_conversations(rows: DataFrame, *, chunk_bits: int = CHUNK_BITS, fixups: int = FIXUPS) -> DataFrame:
    """The edits that repair each conversation: conv_id, place, turn, role, text, fault, copies, inserted, edit and given_role.

    A row's fault is 'blank' (no visible character), 'duplicate' (role and text stood before in the
    conversation) or 'truncated' (last visible character not one of .!?), the first that holds, or
    null.  edit is K, R (to given_role) or D; ``inserted`` has the initials of the empty turns put
    before the row; ``copies`` further rows equal this one and are deleted.  A row with an empty
    edit, last in its conversation, holds what is inserted at the end.  The edits cost least, and
    their initials in order (D, I, K, R) are the ASCII-least of those that do.

    Null roles and texts are one space; a null conv_id is a conversation; equal turns stand by role
    and text; roles count by their first character; other columns are ignored.  A conversation
    without rows has no edits; an empty table gives none.
    """
    placed = stage(ordered_rows(rows), "repair-rows")
    again = placed.where("not blank").groupBy("conv_id", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stage(again.select(F.col("conv_id").alias("again_conv"), F.col("key").alias("again_key"), "first"), "repair-again")
    light = placed.where("not blank").select("conv_id", "place", "key", (F.col("initial") * 2 + F.col("truncated").cast("int")).cast("byte").alias("code"))
    first = light.join(again, F.col("conv_id").eqNullSafe(F.col("again_conv")) & (F.col("key") == F.col("again_key")), "left").where("first is null or first = place")
    pieces = first.groupBy("conv_id", F.shiftright("place", chunk_bits).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    chunks = stage(pieces.select("conv_id", F.col("rows")[0]["place"].alias("id"), F.transform("rows", lambda r: (r["place"] - F.col("rows")[0]["place"]).cast("int")).alias("offsets"), F.col("rows.code").alias("codes")), "repair-chunks")
    order = Window.partitionBy("conv_id").orderBy("id")
    links = stage(chunks.select("conv_id", "id", F.lead("id").over(order).alias("next"), F.lag("id").over(order).alias("back")), "repair-links")
    several = links.where("next is not null or back is not null")
    end = F.array(*(F.lit(int(x)) for x in normal(END)))
    light_chunks = chunks.join(links.select("id", "next"), "id")
    if several.limit(1).count():
        long = stage(chunks.join(several.select("id", "next"), "id").select("conv_id", "id", "next", "codes"), "repair-long")
        ends = stage(_settled(long, fixups), "repair-ends")
        entries = stage(_entries(long.join(ends, "id")), "repair-entries")
        known = light_chunks.join(ends.join(entries, "id"), "id", "left").withColumns({"end": F.coalesce("end", end), "entry": F.coalesce("entry", F.lit(START))})
    else:
        known = light_chunks.withColumns({"end": end, "entry": F.lit(START).cast("long")})
    kind = dict(rows.dtypes)["conv_id"]
    known = known.select("conv_id", "id", "offsets", "codes", F.transform("end", lambda c: c.cast("long")).alias("end"), F.col("entry").cast("long").alias("entry"), F.col("next").isNull().alias("final"))
    edits = stage(known.mapInArrow(_traced, f"conv_id {kind}, place long, inserted string, edit string, given_role string"), "repair-edits")
    discard(chunks, links, again)
    own = edits.where(F.col("place") < LAST_PLACE).drop("conv_id")
    fault = F.when(F.col("blank"), "blank").when(F.col("edit").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    out = placed.join(own, "place", "left").select("conv_id", "place", "turn", "role", "text", fault.alias("fault"), "copies", F.coalesce("inserted", F.lit("")).alias("inserted"), F.coalesce("edit", F.lit("D")).alias("edit"), "given_role")
    types = dict(out.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    closing = edits.where(F.col("place") == LAST_PLACE).select("conv_id", "place", none("turn"), none("role"), none("text"), none("fault"), F.lit(0).cast("long").alias("copies"), "inserted", "edit", none("given_role"))
    return out.unionByName(closing)


def report(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``, from the edits of :func:`repair_conversations`.

    conv_id, gaps (turn numbers missing between the smallest and the largest), blank, duplicate,
    truncated, illegal (neighbouring role initials other than su, ua and au), cost, audit (the
    edits' initials in order) and repaired_sha256 (of `role:text` of all turns left, newline-joined).
    Conversations without edits have zeros.  A conversation's rows stream through one task in order,
    as a hash must read them; the task holds only sums and the audit.
    """
    kind = dict(edits.dtypes)["conv_id"]
    marks = conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("place"))
    rows = edits.unionByName(marks, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        held = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held is None or r["conv_id"] != held.conv:
                    if held is not None:
                        done.append(held.row())
                    held = _Report(r["conv_id"])
                if r["place"] >= 0:
                    held.add(r)
            yield _rows(done)
        yield _rows([held.row()] if held is not None else [])
        give_back()

    conv = edits.select("conv_id").limit(0).toArrow().schema.field("conv_id").type

    def _rows(done: list) -> pa.RecordBatch:
        types = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Report:
    """Sums over a conversation's rows in order."""

    def __init__(self, conv):
        self.conv, self.low, self.high, self.turns, self.initial = conv, None, None, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def add(self, r: dict) -> None:
        for i in r["inserted"]:
            self.line("user" if i == "u" else "assistant", "")
        self.cost += INSERT * len(r["inserted"])
        self.audit.append("I" * len(r["inserted"]) + r["edit"] + "D" * r["copies"])
        if not r["edit"]:
            return
        if r["turn"] is not None and r["turn"] != self.high:
            self.low = r["turn"] if self.low is None else self.low
            self.high, self.turns = r["turn"], self.turns + 1
        initial = r["role"][:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.illegal += r["copies"]
        if r["fault"]:
            self.faults[r["fault"]] += 1
        self.faults["blank" if r["fault"] == "blank" else "duplicate"] += r["copies"]
        more = TRUNCATED if r["fault"] == "truncated" else 0
        self.cost += DELETE * r["copies"] + {"D": DELETE, "K": more, "R": RENAME + more}[r["edit"]]
        if r["edit"] != "D":
            self.line(r["given_role"] or r["role"], r["text"])

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
