"""Spelling variants, conversation repair and chat formatting against brute force and their stated edge cases."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, queries, repair, spelling

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long"


def sql_of(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(f"{k}_rows", v)
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM {k}_rows")
    return con.execute(queries.SQL[name])


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    """The stated rules over all pairs of words."""
    form, out = {}, {}
    for w in counts:
        others = sorted((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o))
        form[w] = others[0] if others and counts[others[0]] >= 2 * counts[w] else None
        out[w] = [len(others)]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], out[w][0], counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("block, tile", [(1_024, 4_096), (8, 16), (10**6, 5)])
def test_variants_against_all_pairs(spark, block, tile):
    """Edits of every kind, anagrams, chains of forms, dense sets of words; whole blocks, many blocks, and one block of many tiles."""
    rng = np.random.default_rng(2)
    counts = {}
    for stem in ("vector", "letters", "éclair", "aaaaa", "ababa"):
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.integers(0, 3)):
                at, c = rng.integers(0, len(w)), str(rng.choice(list("abeétrÀ÷")))
                kind = rng.integers(0, 3)
                w = w[:at] + w[at + 1 :] if kind == 0 else w[:at] + [c] + w[at:] if kind == 1 else w[:at] + [c] + w[at + 1 :]
            counts["".join(w)] = int(rng.choice([3, 4, 8, 9, 40, 200]))
    counts |= {"listen": 5, "silent": 5, "x" * 300: 7, "x" * 301: 20, "x" * 150 + "y" + "x" * 150: 3}
    rows = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int").repartition(3)
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(rows, block=block, tile=tile).collect()}
    want = brute_variants(counts)
    assert got == want and any(v[0] and want[v[0]][0] for v in want.values())


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_runs_of_a_text_in_pieces(monkeypatch, piece):
    """Pieces end between runs: the same runs as of the whole text, wherever it is cut."""
    monkeypatch.setattr(spelling, "PIECE_CHARS", piece)
    for text in ("", "a", "  ", "abc", "one twoÉ-three\n four5five × end ", "x" * 50 + " y", "日本 word" * 9):
        got = collections.Counter()
        for run, n in spelling._runs(text):
            got[run] += n
        assert got == collections.Counter(spelling.RUN.findall(text))


def test_words_of_texts(spark):
    """Damage by crc32 of id and word, lower case of A-Z alone, empty, null and long texts, repeated rows and null ids."""
    texts = ["Étage étage ÉTAGE word-Words words_WORDS", "", None, "one two three " * 500, "ab" * 40_000 + " end", "naïve café×÷ " * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0]), (None, texts[3])]
    for lose in (0, 97, 2):
        want = collections.Counter()
        for i, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if lose and h % lose == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += len(run) >= 5
        docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)
        got = {r.word: r.n for r in spelling.word_counts(docs, lose_every=lose).collect()}
        assert got == {w: n for w, n in want.items() if n >= 3}
    empty = spark.createDataFrame([], DOCS)
    assert spelling.group_variants(spelling.word_counts(empty)).count() == 0


def test_spelling_query_against_all_pairs(spark):
    """The query and its SQL over the whole small table, against all pairs."""
    got = queries.QUERIES["op11_spelling"](spark, SMALL).collect()
    counts = {r.word: r.n for r in got}
    assert len(counts) == len(got) and {r.word: tuple(r)[1:] for r in got} == brute_variants_by_length(counts)


def brute_variants_by_length(counts):
    """As :func:`brute_variants`, comparing only words whose lengths differ by one at most."""
    by = collections.defaultdict(list)
    for w in counts:
        by[len(w)].append(w)
    form, number = {}, {}
    for w in counts:
        others = [o for k in (-1, 0, 1) for o in by[len(w) + k] if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w], number[w] = best if best and counts[best] >= 2 * counts[w] else None, len(others)
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], number[w], counts[form[w]] if form[w] else None)
    return out


# ---------------------------------------------------------------- repair


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEVER = (10**9, "", ())


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows (turn, role, text), by plain dynamic programming over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        seen_text = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not seen_text else "duplicate" if (role, text) in seen else "truncated" if seen_text[-1] not in ".!?" else None)
        seen.add((role, text))
    after = [NEVER] * 4
    for t in range(len(rows), -1, -1):
        here = [NEVER] * 4
        for s in range(4):
            options = [NEVER] + [(0, "", ())] * (t == len(rows) and s in (0, 3))
            if t < len(rows):
                _, role, text = rows[t]
                add = lambda cost, edit, to, line: options.append((cost + after[to][0], edit + after[to][1], line + after[to][2]))
                add(2, "D", s, ())
                if faults[t] not in ("blank", "duplicate"):
                    more = 5 * (faults[t] == "truncated")
                    if (s, role[:1]) in STEP:
                        add(more, "K", STEP[s, role[:1]], ((role, text),))
                    for given in ("user", "assistant"):
                        if (s, given[0]) in STEP:
                            add(1 + more, "R", STEP[s, given[0]], ((given, text),))
            here[s] = min(options, key=lambda o: o[:2])
        for _ in range(4):
            for (s, i), to in STEP.items():
                if i != "s":
                    option = (5 + here[to][0], "I" + here[to][1], (({"u": "user", "a": "assistant"}[i], ""),) + here[to][2])
                    here[s] = min(here[s], option, key=lambda o: o[:2])
        after = here
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = collections.Counter(faults)
    lines = "\n".join(f"{r}:{x}" for r, x in after[0][2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, after[0][0], after[0][1], hashlib.sha256(lines.encode()).hexdigest())


TALK = "conv_id long, turn long, role string, text string, place long, cost string"


def reports(spark, rows, asked=(), **options):
    talk = spark.createDataFrame([(*r, 1, "clash") for r in rows], TALK).repartition(3)
    every = spark.createDataFrame([(*r, 1, "clash") for r in [*rows, *asked]], TALK)
    return {r[0]: tuple(r)[1:] for r in repair.report(repair.repair_conversations(talk, **options), every).collect()}


def wanted(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    return {c: brute_repair(v) for c, v in by.items()}


@pytest.mark.parametrize("chunk_bits, fixups", [(12, 3), (2, 50), (1, 0), (3, 1)])
def test_repair_against_brute_force(spark, chunk_bits, fixups):
    """Random conversations in one chunk and in many, with fix-up passes to the end, a few, or the matrices alone."""
    rng = np.random.default_rng(chunk_bits)
    texts, roles = ["One.", "Two!", "cut off", "Three? ", "", " \t", "four\n", "Five."], ["user", "assistant", "system", "tool", "ugly"]
    rows = [(c, t, str(rng.choice(roles, p=[0.4, 0.4, 0.1, 0.05, 0.05])), f"{rng.choice(texts)}" if rng.random() < 0.3 else f"Text {c} {t}{rng.choice(['.', '!', ''], p=[0.7, 0.2, 0.1])}") for c in range(30) for t in sorted(rng.choice(60, int(rng.integers(1, 40)), replace=False).tolist())]
    # Never converging: long runs of truncated rows; of blank rows; of one role.
    rows += [(100, t, "user", f"open {t}") for t in range(70)] + [(101, t, "user", "") for t in range(50)] + [(102, t, "assistant", f"Said {t}.") for t in range(50)]
    rows += [(103, t, ("user", "assistant")[t % 2], f"Said {t}.") for t in range(60)] + [(103, 60 + t, "assistant", f"open {t}") for t in range(40)]
    want = wanted(rows)
    assert reports(spark, rows, chunk_bits=chunk_bits, fixups=fixups) == want
    # Deleting a neighbour is always cheaper than inserting, so no cheapest audit inserts.
    assert set("".join(v[6] for v in want.values())) == {"K", "R", "D"}


def test_repair_edge_cases(spark):
    """Nulls in every column, repeated rows and turns, roles of any name, a conversation without rows, no rows at all."""
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (1, None, "user", "Hi."), (2, 5, "user", "Hi."), (2, 5, "user", "Hi."), (2, 5, "user", "Hi."), (2, 9, "assistant", "x" * 200_000 + "."), (3, 0, "", "Hi."), (3, 1, "system", "S."), (4, 7, "user", " ")]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reports(spark, rows, asked=[(9, 0, "user", "dropped")]) == wanted(rows) | {9: empty}
    assert reports(spark, [], asked=[]) == {} and reports(spark, [], asked=[(9, 0, "user", "x")]) == {9: empty}


def test_fixed_up_stops_where_vectors_are_parallel():
    """Rerun chunks have the vectors of a run from the true end; chunks whose ends are parallel are not run."""
    rng = np.random.default_rng(1)
    sizes = np.array([50, 3, 1, 80, 20])
    codes = rng.choice(8, sizes.sum(), p=[0.1, 0.02, 0.4, 0.04, 0.4, 0.02, 0.01, 0.01])
    codes[-20:] = 3
    old, new = rng.integers(0, 12, (5, 4)), rng.integers(0, 12, (5, 4))
    new[1] = old[1] + 7
    start = repair.backward(codes, sizes, old)[2]
    assert (repair.fixed_up(codes, sizes, old, new, start) == repair.normal(repair.backward(codes, sizes, new)[2])).all()


def test_repair_query_against_brute_force(spark):
    """The query over the whole table: damage and repair."""
    rows, kept = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)
        kept += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_repair"](spark, SMALL).collect()}
    assert got == {c: wanted(kept).get(c, empty) for c in {r[0] for r in rows}}


# ---------------------------------------------------------------- chat


LOG = "conv_id long, seq long, message long, kind string, role string, text string, formatted string"


def test_events_fold_to_messages(spark):
    """Deltas, edits and regenerations over many spans, repeated events, ties, nulls, unknown kinds, an empty log."""
    rng = np.random.default_rng(3)
    rows, seq = [], 0
    for c in (1, 2, None):
        for m in range(4):
            for _ in range(int(rng.integers(1, 1_500))):
                seq += int(rng.integers(1, 3))
                kind = str(rng.choice(["delta", "edit", "regenerate", "noise"], p=[0.97, 0.01, 0.01, 0.01]))
                rows.append((c, seq, m, kind, None if rng.random() < 0.9 else f"r{seq % 3}", None if kind == "regenerate" else f"{seq % 10}"))
    rows += [(7, 5, 1, "delta", "user", "a"), (7, 5, 1, "delta", "user", "a"), (7, 5, 1, "edit", None, "B"), (7, None, 1, "delta", None, "lost"), (7, 6, None, "delta", "x", None), (7, 9, 2, "noise", "x", "y")]
    want = {}
    order = {"delta": 0, "edit": 1, "regenerate": 2}
    for c, s, m, kind, role, text in sorted(set(r for r in rows if r[3] in order), key=lambda r: (r[1] is not None, r[1] or 0, order[r[3]], r[5] or "")):
        first, old_role, old = want.get((c, m), (s, None, ""))
        want[c, m] = (first if first is not None else s, role if role is not None else old_role, (old if kind == "delta" else "") + (text or ""))
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    assert {(r.conv_id, r.message): (r.first_seq, r.role, r.text) for r in chat.fold_events(log.repartition(5)).collect()} == want
    assert chat.read_back(chat.render(chat.fold_events(log.limit(0)))).count() == 0


def test_rendered_conversations_read_back(spark):
    """Control strings in texts and roles, cut anywhere, come back whole; the mask covers the assistant's texts alone."""
    parts = ["\\", "#", "##", "###", "</turn>", "</turn>\n", "</tur", "n>", ": ", ":", "\n", "\\h", "\\t", "\\b", "\\c", "### assistant: ", "é😀", "", " "]
    rng = np.random.default_rng(9)
    make = lambda: "".join(rng.choice(parts, rng.integers(0, 7)).tolist())
    rows = [(c, m, m, "assistant" if rng.random() < 0.5 else make(), make()) for c in range(60) for m in range(8)] + [(99, 0, 0, None, None), (None, 1, 1, "assistant", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, first_seq long, message long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    for c in {r[0] for r in rows}:
        mine = [(r[3] or "", r[4] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c].turns] == mine and got[c].learned == [x for role, x in mine if role == "assistant"]
        assert got[c].formatted.count("</turn>\n") == got[c].formatted.count("### ") == len(mine)


def test_chat_query_with_nulls_ties_and_long_texts(spark, tmp_path):
    """The query over a table of odd rows, against plain hashes."""
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 0, "user", "a"), (1, None, "assistant", "first"), (1, 2, None, None), (None, 0, "assistant", "n"), (2, 0, "assistant", "é" * 100_001), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string").write.parquet(str(tmp_path / "conversations.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c in (1, 2, None, -7):
        own = sorted((r for r in rows + [(-7, 0, "user", rows[0][3]), (-7, 1, "assistant", rows[0][3])] if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        want[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    got = {r.conv_id: tuple(r)[1:5] for r in queries.QUERIES["op13_chat"](spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("name, table", [("op11_spelling", "documents"), ("op13_chat", "conversations")])
def test_queries_equal_sql(spark, name, table):
    got = queries.QUERIES[name](spark, SMALL)
    want = sql_of(name, **{table: spark.read.parquet(f"{SMALL}/{table}.parquet").toArrow()})
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
