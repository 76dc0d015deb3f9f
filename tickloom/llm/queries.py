"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, minhash, mixing, pivot_index, quality, repair, sanitise, spelling, token_store, topk, toxicity, url_filter
from .common import new_path, table, train_fold

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    return token_store.read_tokens(spark, path).drop("ids")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.drop("source")


def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def _url_lists(pages: DataFrame) -> DataFrame:
    """A list log derived from the pages: some captures list or delist their host, domain, whole path or its first step when fetched."""
    host = url_filter.host_of(F.col("url"))
    step = F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^/?#]+(?:/[^/?#]+)*)", 1)
    step = F.when(F.col("page_id") % 40 < 20, step).otherwise(F.regexp_extract(step, "^[^/]*", 0))
    domain = F.regexp_replace(host, r"^[^.]*\.", "")
    m = F.col("page_id") % 20
    kind = F.when(m.isin(3, 7, 11), "host").when(m.isin(4, 14), "domain").when(m.isin(5, 9, 19), "prefix")
    key = F.when(kind == "host", host).when(kind == "domain", domain).otherwise(F.concat(host, F.lit("/"), step))
    return pages.select(F.when(m.isin(11, 19), "allow").otherwise("block").alias("list"), kind.alias("kind"), key.alias("key"), F.when(m.isin(7, 14, 9) | (F.col("page_id") % 3 == 0), "remove").otherwise("add").alias("action"), F.col("fetched_at").alias("at"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # Four pages are fetched within a second, and the next four minutes later.
    pages = pages.withColumn("fetched_at", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.floor(F.col("page_id") / 4) * 240_000_000 + F.pmod("page_id", F.lit(4)) * 200_000))
    found = url_filter.evaluate_captures(pages, _url_lists(pages))
    return found.select("page_id", "blocked", "n_active", F.unix_micros("fetched_at").alias("fetched_us"), F.unix_micros("blocked_since").alias("since_us"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents"), lose_every=97))


def _damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that crc32 of `conv_id:turn` deals out (nulls are one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.repair_conversations(_damaged(rows)), rows)


#: A conversation of its own, whose texts hold the template's control strings.
CONTROL = "\\### Assistant: </turn> ok"
#: Deltas of a message are at least so many code points, and at most PIECES.
DELTA, PIECES = 64, 32


def _chat_log(conversations: DataFrame) -> DataFrame:
    """An event log of the conversations: every message is streamed in deltas; some are drafted and edited, some regenerated.

    Rows stand by turn (nulls first), then role and text; the sequence follows that order.
    """
    spark = conversations.sparkSession
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).union(own)
    order = ["conv_id", "turn", "role", "text"]
    # Ranges need no more of a text than its first characters: whole texts would travel to the driver in their sample.
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*order).withColumn("message", F.monotonically_increasing_id())
    size = F.length("text")
    width = F.greatest(F.lit(DELTA), F.ceil(size / PIECES)).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cut = lambda i: F.substring("text", i * F.col("width") + 1, F.col("width"))
    streamed = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / F.col("width")).cast("int") - 1, F.lit(0))), lambda i: event("delta", cut(i)))
    kind = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")), F.lit(4))
    edited = F.concat(F.array(event("delta", F.reverse("text"))), F.array(event("edit", cut(F.lit(0)))), F.slice("streamed", 2, PIECES))
    again = F.concat(F.slice("streamed", 1, PIECES // 2), F.array(event("regenerate", F.lit(None).cast("string"))), F.col("streamed"))
    rows = rows.withColumn("width", width).withColumn("streamed", streamed)
    rows = rows.select("conv_id", "message", "role", F.posexplode(F.when(kind == 0, edited).when(kind == 1, again).otherwise(F.col("streamed"))).alias("at", "event"))
    return rows.select("conv_id", "message", (F.col("message") * (2 * PIECES) + F.col("at")).alias("seq"), "event.kind", "role", "event.text")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = chat.read_back(chat.render(chat.fold_events(_chat_log(table(spark, sf_dir, "conversations")))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_store, op2_url_filter, op3_pivot_index, op4_top_k, op5_mixing, op6_sanitise, op7_bpe, op8_minhash, op9_quality, op10_toxicity, op11_spelling, op12_repair, op13_chat)}

_OP4_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 10
"""
_OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON e.vec_id = k.a
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON e.vec_id = c.a
"""
_OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n, 2.0::DOUBLE * source_size AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
w AS (SELECT *, [3, 1, 2][((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (
  SELECT *, least(most, weight * (SELECT arg_min(level, {'a': most / weight, 'b': n}) FROM f WHERE level * weight <= most)) AS target FROM f),
p AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS last FROM d)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (greatest(0, least(p.last, floor(g.target)) - (p.last - p.size))
        + greatest(0, least(p.last, floor(g.target) - g.source_size) - (p.last - p.size)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
_OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, 1704067200000000 + page_id // 4 * 240000000 + page_id % 4 * 200000 AS ts, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         CASE WHEN page_id % 40 < 20 THEN regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+(?:/[^/?#]+)*)', 1) ELSE regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+)', 1) END AS step, page_id % 20 AS m,
         list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*((?:/[^/?#]+)*)', 1), '/'), lambda s: s <> '') AS steps FROM pages),
e AS (
  SELECT CASE WHEN m IN (11, 19) THEN 'allow' ELSE 'block' END AS list,
         CASE WHEN m IN (3, 7, 11) THEN 'host' WHEN m IN (4, 14) THEN 'domain' WHEN m IN (5, 9, 19) THEN 'prefix' END AS kind,
         CASE WHEN m IN (3, 7, 11) THEN host WHEN m IN (4, 14) THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/' || step END AS key,
         ts, min(CASE WHEN m IN (7, 14, 9) OR page_id % 3 = 0 THEN 0 ELSE 1 END) AS act FROM p WHERE m IN (3, 7, 11, 4, 14, 5, 9, 19) GROUP BY 1, 2, 3, 4),
k AS (
  SELECT page_id, ts, 'host' AS kind, host AS key FROM p WHERE host <> ''
  UNION SELECT page_id, ts, 'domain', array_to_string(string_split(host, '.')[-i:], '.') FROM (SELECT *, unnest(range(2, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION SELECT page_id, ts, 'prefix', host || '/' || array_to_string(steps[1:i], '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM p WHERE host <> '')),
c AS (
  SELECT *, lead(ts) OVER (PARTITION BY list, kind, key ORDER BY ts) AS until FROM (
    SELECT *, coalesce(lag(act) OVER (PARTITION BY list, kind, key ORDER BY ts), 0) AS was FROM e) WHERE act <> was),
a AS (
  SELECT k.page_id, count(*) AS n, max(c.ts) FILTER (c.list = 'block') AS since, count(*) FILTER (c.list = 'allow') AS allowed
  FROM k JOIN c ON k.kind = c.kind AND k.key = c.key AND c.act = 1 AND c.ts <= k.ts AND (c.until IS NULL OR c.until > k.ts) GROUP BY 1)
SELECT p.page_id, coalesce(since IS NOT NULL AND allowed = 0, false) AS blocked, coalesce(n, 0)::BIGINT AS n_active, p.ts AS fetched_us,
       CASE WHEN allowed = 0 THEN since END AS since_us FROM p LEFT JOIN a USING (page_id)
"""
_OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT doc_id, text, 0 AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ps FROM d
  UNION ALL SELECT doc_id, text, 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT doc_id, text, 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), string_split_regex(text, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, text, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
u AS (SELECT doc_id, text, kind, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM k),
v AS (
  SELECT doc_id, text, kind, ms[i] AS value, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
         list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a FROM u),
b AS (
  SELECT doc_id, text, kind, value, a::BIGINT AS a, (a + length(value))::BIGINT AS z,
         kind || ':' || CASE kind WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE digits END AS entity FROM v
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN regexp_full_match(value, '0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}')
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN (length(digits) - j) % 2 = 0 THEN digits[j]::INT WHEN digits[j]::INT > 4 THEN 2 * digits[j]::INT - 9 ELSE 2 * digits[j]::INT END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
c AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\p{L}+'), lambda m: lower(m)))) AS term FROM d),
df AS (SELECT term, count(*) AS n_term FROM c GROUP BY 1),
holds AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM b GROUP BY 1),
pairs AS (SELECT entity, term, count(*) AS n_both FROM (SELECT DISTINCT doc_id, entity FROM b) JOIN c USING (doc_id) GROUP BY 1, 2),
n AS (SELECT count(*) + 1.0::DOUBLE AS n FROM d),
f AS (SELECT entity, term FROM pairs JOIN holds USING (entity) JOIN df USING (term), n
      WHERE -ln((n_entity + 1) / n) > 0 AND ln(n_both / n_entity / ((n_term + 1) / n)) >= -ln((n_entity + 1) / n) / 1.5),
t AS (SELECT b.doc_id, any_value(b.text) AS text, list(DISTINCT f.term) AS terms FROM b JOIN f USING (entity) GROUP BY 1),
r AS (SELECT doc_id, terms, regexp_extract_all(text, '\p{L}+') AS ms, string_split_regex(text, '\p{L}+') AS ps FROM t),
q AS (SELECT doc_id, terms, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM r),
w AS (
  SELECT doc_id, 4 AS kind, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(ms[i]) AS n
  FROM q WHERE list_contains(terms, lower(ms[i]))),
s AS (SELECT doc_id, kind, a, z FROM b UNION ALL SELECT doc_id, kind, a, a + n FROM w),
o AS (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || a || ':' || z AS x FROM s),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(x, ',' ORDER BY a, kind, z) FILTER (kind < 4) AS base, string_agg(x, ',' ORDER BY a, kind, z) AS spans FROM o GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
_OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b AS v, 0 AS i FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE i = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bs FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bs, lambda b: b::BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, {'a': -m, 'b': other}) AS form, max(m) AS form_n FROM near GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
up AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT up.word, f.word, f.form FROM up JOIN formed f ON up.next = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM formed f JOIN up ON f.word = up.word AND up.next IS NULL
"""
_OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS t,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 14)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
SQL: dict[str, str] = {"op13_chat": _OP13_SQL, "op11_spelling": _OP11_SQL, "op6_sanitise": _OP6_SQL, "op2_url_filter": _OP2_SQL, "op5_mixing": _OP5_SQL, "op3_pivot_index": _OP3_SQL, "op4_top_k": _OP4_SQL}
