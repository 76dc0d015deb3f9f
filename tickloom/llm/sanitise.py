"""Personal data and what reveals it: base patterns, and terms whose co-occurrence discloses them.

Base spans (email, ip, card, phone) are found by patterns and checks.  Every value found is a
protected entity e.  Over the whole corpus, a term t (a run of letters) of documents that hold e
discloses it if PMI(e; t) >= IC(e) / alpha (C-sanitisation, Sanchez and Batet, 2016), where
IC(e) = -log p(e) and PMI(e; t) = log(p(t | e) / p(t)).  n counts whole documents, all of them:
p(t | e) = n(e, t) / n(e), and p(x) = (n(x) + 1) / (N + 1), smoothed by one document, so that what
was never seen elsewhere doesn't count as certain never to be.  Entities and terms of a single
document are judged as well.  In documents that hold e, all places of its disclosing terms become
spans, which are generalised.  Kinds are no entities: the mark that replaces a span names its kind.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, packed, stage, unpacked

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns, written so that no text makes them backtrack: an address starts where its
# run of characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
TERM = r"\p{L}+"
ALPHA = 1.5
#: Documents added to the counts of an entity and of a term.
SMOOTHING = 1.0
#: Values of more than this share of the documents meet their counts by a broadcast, if no more than so many do (about 20 MB).
HOT_SHARE, BROADCAST_VALUES = 1e-3, 200_000
SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d: d.cast("int"))
    worth = F.transform(F.filter(digits, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + d) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike("[0-9]\\.[0-9]"), "card": lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, step, kind: str) -> Column:
    """What ``step(at, item)`` gives for each item, an array; it returns the next ``at`` (from 0) and an array of what to add.

    The array is put together in about sqrt(n) parts, so that no long array is copied for each item.
    """
    none, zero = F.array().cast(f"array<{kind}>"), F.lit(0).cast("int")

    def one(acc, item):
        at, more = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def whole(xs):
        k = F.ceil(F.sqrt(F.size(xs))).cast("int")
        part = lambda acc, c: F.aggregate(F.slice(xs, c * k + 1, k), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        add = lambda acc, c: _let(part(acc, c), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(F.sequence(zero, F.greatest(k - 1, zero)), F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), add, lambda acc: F.flatten(acc["out"]))

    return _let(items, whole)


def _places(text: Column, pattern: Column, kind: str, check) -> Column:
    """Spans of the pattern's leftmost matches that pass the check, in code points."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    items = _let(found, lambda f: F.zip_with(F.slice(between, 1, F.size(f)), f, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("value"))))
    empty = F.array().cast(SPAN)

    def step(at, item):
        start = at + item["gap"]
        end = start + F.length(item["value"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), item["value"].alias("value"))
        return end, F.when(check(item["value"]), F.array(span)).otherwise(empty)

    return _folded(items, step, SPAN[len("array<") : -1])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.when(HINTS[k](text), _places(text, F.lit(PATTERNS[k]), k, CHECKS[k])).otherwise(F.array().cast(SPAN)) for k in PATTERNS]
    return F.array_sort(F.concat(*parts))


def _entity(span: Column) -> Column:
    """What a span protects: its kind, and its address in lower case or its digits."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"])))


def _terms(text: Column) -> Column:
    """The distinct terms of a text: its runs of letters, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower))


def _counted(rows: DataFrame, counts: DataFrame, key: str, columns: list[str], n: str, total: float, keep: Column) -> DataFrame:
    """Rows joined with those counts of their ``key`` that ``keep`` holds for; ``counts`` is a written table.

    Keys of many rows are broadcast (their number is at most that of values in a document / HOT_SHARE,
    and it is checked), so that no task gathers their rows; the others meet by shuffle.
    """
    hot = counts.where(F.col(n) > HOT_SHARE * total)
    if not 0 < hot.count() <= BROADCAST_VALUES:
        return rows.join(counts.where(keep).select(key, *columns), key)
    held = rows.join(F.broadcast(hot.select(key, F.struct(*columns).alias("k_hot"))), key, "left")
    cold = held.where("k_hot is null").drop("k_hot").join(counts.where((F.col(n) <= HOT_SHARE * total) & keep).select(key, *columns), key)
    return held.where("k_hot is not null").select(*rows.columns, "k_hot.*").where(keep).select(*cold.columns).union(cold)


def disclosing_terms(docs: DataFrame, dirty: DataFrame, *, alpha: float = ALPHA, smoothing: float = SMOOTHING) -> DataFrame:
    """p_row and term: what discloses an entity of the row; ``dirty`` has p_row, text and base of documents with base spans.

    Entities that stand in the same documents have the same counts and are judged as one (a class,
    known by its size and 128 bits of hash over its documents), so a text that holds thousands of
    values is not multiplied by its words.
    """
    size = docs.count()
    total = F.lit(size + smoothing)
    share = lambda n: (F.col(n) + smoothing) / total
    entities = dirty.select("p_row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    held = stage(entities.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("p_row", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("p_row", F.lit(2))).alias("h2")), "entity-counts")
    counted = _counted(entities, held, "entity", ["n_entity", "h1", "h2"], "n_entity", size, F.lit(True))
    classes = stage(counted.select("p_row", "n_entity", "h1", "h2").distinct(), "entities")
    # As p(t | e) <= 1, PMI reaches IC / alpha only if p(t) <= p(e) ** (1 / alpha): other terms aren't joined.
    rare = F.pow(share("n_entity"), F.lit(1 / alpha)) * (1 + 1e-9)
    largest = classes.agg(F.max(rare)).first()[0] or 0.0
    counts = stage(docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "term-counts")
    words = _counted(dirty.select("p_row", F.explode(_terms(F.col("text"))).alias("term")), counts, "term", ["n_term"], "n_term", size, share("n_term") <= largest)
    pairs = stage(words.join(classes, "p_row").where(share("n_term") <= rare).select("p_row", "n_entity", "h1", "h2", "term", "n_term"), "terms")
    keys = ["n_entity", "h1", "h2", "term"]
    both = pairs.groupBy(*keys, "n_term").agg(F.count("*").alias("n_both"))
    ic = -F.log(share("n_entity"))
    pmi = F.log(F.col("n_both") / F.col("n_entity") / share("n_term"))
    # Written first, so that Spark may split the rows of an entity and a term that many documents hold together.
    found = stage(both.where((ic > 0) & (pmi >= ic / alpha)).select(*keys), "disclosing")
    discard(held, counts)
    return pairs.join(found, keys, "left_semi").select("p_row", "term").distinct()


def found_spans(docs: DataFrame, *, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """``clean`` rows of ``docs`` without base spans, and ``dirty`` rows with ``base`` and ``spans`` added.

    Both keep all columns.  ``spans`` holds the base spans and those of disclosing terms, by start
    and then kind.  Null and empty texts are clean.  Rows that repeat are documents of their own.
    """
    docs = docs.drop("base", "spans")
    all_base = base_spans(F.col("text"))
    clean = docs.where(F.size(all_base) == 0)
    dirty = stage(docs.withColumn("base", all_base).where(F.size("base") > 0).withColumn("p_row", F.monotonically_increasing_id()), "personal")
    reveals = disclosing_terms(docs, dirty, alpha=alpha)
    # Places of all words of these documents meet their disclosing terms by equality.
    placed = dirty.select("p_row", F.explode(_places(F.coalesce("text", F.lit("")), F.lit(TERM), "term", lambda m: F.lit(True))).alias("s")).withColumn("term", F.lower("s.value"))
    own = placed.join(reveals, ["p_row", "term"], "left_semi").groupBy("p_row").agg(F.collect_list("s").alias("p_own"))
    dirty = dirty.join(own, "p_row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("p_own", F.array().cast(SPAN)))))
    return clean, dirty.drop("p_row", "p_own")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, hash of the base spans, and all spans as text, of every row."""
    clean, dirty = found_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    zero = [F.lit(0).cast("long").alias(f"n_{k}") for k in PATTERNS]
    nothing = clean.select("doc_id", *zero, F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return nothing.union(dirty.select("doc_id", *map(count, PATTERNS), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")))


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, same columns, with every span's text replaced by its kind's mark (n_chars follows, if there).

    Where spans overlap, the mark of the first stands for them all.  Null and empty texts stay.
    """
    clean, dirty = found_spans(packed(docs, "text"))
    marks = F.array(*(F.lit(MARKS[k]) for k in KINDS))

    def step(at, span):
        # A span that starts within the last one adds no mark of its own.
        new = F.when(span["start"] >= at, F.array(F.struct(at.alias("from"), span["start"].alias("to"), F.get(marks, span["kind"]).alias("mark"), span["end"].alias("end"))))
        return F.greatest(at, span["end"]), F.coalesce(new, F.array().cast("array<struct<from: int, to: int, mark: string, end: int>>"))

    def written(pieces):
        """Text before each mark and the mark; text is cut in sqrt(n) parts first, as each cut counts characters from the start."""
        k = F.greatest(F.ceil(F.sqrt(F.size(pieces))).cast("int"), F.lit(1))
        cut = lambda text, a, b: F.substring(text, a + 1, b - a)

        def part(c):
            own = F.slice(pieces, c * k + 1, k)
            first, last = F.get(own, F.lit(0))["from"], F.element_at(own, -1)["to"]
            return _let(cut(F.col("text"), first, last), lambda t: F.array_join(F.transform(own, lambda x: F.concat(cut(t, x["from"] - first, x["to"] - first), x["mark"])), ""))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / k).cast("int")), part)
        end = F.element_at(pieces, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(F.col("text"), end + 1, F.length("text")))

    new = _let(_folded(F.col("spans"), step, "struct<from: int, to: int, mark: string, end: int>"), written)
    fixed = dirty.withColumn("text", new)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return unpacked(clean, docs.columns).union(unpacked(fixed, docs.columns, **changed))
