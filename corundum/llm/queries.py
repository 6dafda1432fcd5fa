"""The queries of the training-data operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.llm import bpe, chat, decontaminate, lexical_search, near_dedup, ngram_join, quality, secrets, substring, token_count, toxicity, url_filter, vector_codes
from corundum.llm.common import table, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: In SQL: texts with A-Z lower-cased, and words between white space.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES["op2_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d) q),
twice AS (SELECT s FROM g GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM g JOIN twice USING (s)),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT p.r, count(gone.j) AS n_removed, string_agg(CASE WHEN gone.j IS NULL THEN x END, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN gone ON gone.r = p.r AND gone.j = p.j GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null id isn't held out, nor does it have a label
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~held_out))
    scored = toxicity.score(docs, model, keep=["doc_id"], worst=True)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "worst_score")


#: The one tool of op4: a user's turn calls it, the turn after is its result.
CONTEXT = (chat.Argument("conversation", "integer"), chat.Argument("roles", "array", items=chat.Argument("", "string", enum=("user", "assistant", "system"))))
REPLY = chat.Tool("reply", (chat.Argument("context", "object", properties=CONTEXT), chat.Argument("prompt", "string"), chat.Argument("turn", "integer")))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call of REPLY; the assistant turn after it is its result. Of six turns the
    first four need the user turn two turns later, so that places have to be settled; the others
    need none, but in every seventh conversation the first, which makes a circle."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("turn")
    call_id = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    needs = F.when(turn % 6 < 4, F.array(call_id(turn + 2))).when(F.col("conv_id") % 7 == 0, F.array(call_id(turn - 4))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'user'").select("conv_id", call_id(turn).alias("call_id"), "turn", F.lit("reply").alias("tool"), F.to_json(F.struct("turn", F.col("text").alias("prompt"), F.struct(F.col("conv_id").alias("conversation"), F.array("role").alias("roles")).alias("context"))).alias("arguments"), needs.alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    found = chat.link_calls(calls, results, [REPLY])
    return found.select("conv_id", "call_id", "step", "depth", "status", F.array_join("violations", "; ").alias("violations"), "valid", F.sha2("json", 256).alias("json_sha256"))


# A call needs one other at most, so what it reaches is a path, and its depth is the path's length
# within its step.
ORACLES["op4_chat_formatting"] = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text, CASE WHEN turn % 6 < 4 THEN turn + 2 WHEN conv_id % 7 = 0 THEN turn - 4 END AS need FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
known AS (SELECT DISTINCT conv_id, turn FROM calls),
edges AS (SELECT DISTINCT c.conv_id, c.turn, c.need FROM calls c JOIN known k ON k.conv_id = c.conv_id AND k.turn = c.need),
reach(conv_id, turn, to_turn) AS (SELECT conv_id, turn, need FROM edges UNION SELECT r.conv_id, r.turn, e.need FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.turn = r.to_turn),
steps AS (SELECT k.conv_id, k.turn, greatest(k.turn, coalesce(max(r.to_turn), k.turn)) AS step, coalesce(bool_or(r.to_turn = k.turn), FALSE) AS circle FROM known k LEFT JOIN reach r ON r.conv_id = k.conv_id AND r.turn = k.turn GROUP BY 1, 2),
places AS (SELECT s.conv_id, s.turn, s.step, count(o.turn) AS depth, s.circle OR coalesce(bool_or(o.circle), FALSE) AS stuck FROM steps s LEFT JOIN reach r ON r.conv_id = s.conv_id AND r.turn = s.turn LEFT JOIN steps o ON o.conv_id = s.conv_id AND o.turn = r.to_turn AND o.step = s.step GROUP BY 1, 2, 3, s.circle)
SELECT c.conv_id, concat('call_', c.turn) AS call_id, CAST(CASE WHEN NOT p.stuck THEN p.step END AS BIGINT) AS step, CAST(CASE WHEN NOT p.stuck THEN p.depth END AS INTEGER) AS depth,
  CASE WHEN r.n > 1 THEN 'repeated' WHEN r.n = 1 THEN 'linked' ELSE 'pending' END AS status,
  CASE WHEN c.need IS NOT NULL AND k.turn IS NULL THEN concat('call_', c.need, ' isn''t a call') ELSE '' END AS violations,
  NOT (c.need IS NOT NULL AND k.turn IS NULL) AS valid,
  sha256(concat('{"arguments":{"context":{"conversation":', c.conv_id, ',"roles":["user"]},"prompt":', to_json(c.text), ',"turn":', c.turn, '},"id":"call_', c.turn, '","name":"reply","result":', coalesce(CAST(to_json(r.content) AS VARCHAR), 'null'), '}')) AS json_sha256
FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn
LEFT JOIN known k ON k.conv_id = c.conv_id AND k.turn = c.need JOIN places p ON p.conv_id = c.conv_id AND p.turn = c.turn
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), into="f")
    f = F.col("f")
    hit = F.aggregate(f["spans"], F.lit(0).cast("bigint"), lambda a, x: x - a)  # of start, end, start, end and so on: the ends less the starts
    return found.select("doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES["op5_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_ITEM_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ITEM_WORDS}) AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT k, item_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM s) q),
occ AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM wins) z) q),
hit AS (SELECT DISTINCT r, k, i, item_id FROM occ JOIN wins USING (k, g)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) q GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) q GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
"""


def _linked_sql(size: int, percent: int, more: str = "") -> str:
    """In SQL: n_shingles and component_id of each document. A document by its id: ids are unique in
    the table. Texts with equal sets would meet one by one."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM d WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON b.g = a.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id{more} FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of m ON m.doc_id = d.doc_id
"""


ORACLES["op6_ngram_jaccard_join"] = _linked_sql(5, 75)


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The rules of op8.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


# The given pages link to no other host, so no rank moves: what no rule fits is blocked on hosts most
# of whose pages the rules block.
ORACLES["op8_url_filters"] = """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
b AS (SELECT host FROM r WHERE host <> '' GROUP BY 1 HAVING count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) > 0.5 * count(*))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES, into="f")
    return judged.select("page_id", *(F.col("f")[c].alias(c) for c in ("host", "path", "rule", "verdict")))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.load_vocabulary(tokenizer("piece_bpe_32k.model")))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.log_ratios(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, weights, into="r").select("doc_id", *(F.col("r")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _spans_sql(kind: str, rank: int, pattern: str, least: int, group: int = 0) -> str:
    """In SQL: a list of (start, rank, text) of a rule's matches, from the gaps between them."""
    pattern = "'" + pattern.replace("'", "''") + "'"
    good = f"length(regexp_extract_all(t, {pattern}, {group})[i]) >= {least}" if group else "TRUE"
    size = f"list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda g: length(g)))"
    start = f"CAST({size} + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda g: length(g))), 0) AS BIGINT)"
    one = f"CASE WHEN {good} THEN {{'at': {start}, 'rank': {rank}, 'told': concat('{kind}:', {start}, ':', {start} + length(m))}} END"
    return f"CASE WHEN regexp_matches(t, {pattern}) THEN list_filter(list_transform(regexp_extract_all(t, {pattern}), lambda m, i: {one}), lambda x: x IS NOT NULL) ELSE [] END"


#: Without bounds of its repetitions, which nest too deep for this engine.
_KEY_SQL = re.sub(r"\{0,\d+\}", "*", secrets.PRIVATE_KEY).replace("{1,400}", "+")
#: The rules as they are asked for: kind, pattern, least length and the group that it is of; then what
#: the method adds. AKIA[A-Z0-9]+ of 20 characters and [0-9a-f]+ of 24 are matches of these patterns.
_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "AKIA[A-Z0-9]{16,}", 20),
    ("hex", "[0-9a-f]{24,}", 24),
    ("private_key", _KEY_SQL, 0),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
)
_ALL_SPANS = "list_sort(list_concat(" + ", ".join(_spans_sql(k, i, p, *r) for i, (k, p, *r) in enumerate(_RULES)) + "))"
ORACLES["op7_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, {_ALL_SPANS} AS spans FROM d)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(spans, lambda x: x.rank = {i})) AS BIGINT) AS n_{_RULES[i][0]}" for i in range(3))},
 sha256(array_to_string(list_transform(list_filter(spans, lambda x: x.rank < 3), lambda x: x.told), ',')) AS base_sha256, array_to_string(list_transform(spans, lambda x: x.told), ',') AS spans FROM s
"""


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, f"{work_dir(spark)}/ledger")
    ledger.update(docs, path="doc_id")
    found = ledger.attach(docs).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, every = (tuple(r.kind for r in rules) for rules in (secrets.BASE, secrets.RULES))
    return found.select("doc_id", *map(count, base), F.sha2(secrets.digest(F.col("spans"), base), 256).alias("base_sha256"), secrets.digest(F.col("spans"), every).alias("spans"))


_SIZE = "(SELECT CAST(ceil(max(len(embedding)) / 16) AS INTEGER) FROM embeddings)"


def _round_sql(k: int) -> str:
    """In SQL: the nearest entry of each part in codebook k, and codebook k + 1."""
    return f"""
near{k} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT x.r, x.p, y.e, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN book{k} y ON y.p = x.p) q GROUP BY 1, 2),
means{k} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT n.p, n.best.e AS e, j, CAST(floor(sum(x.v[j]) / count(*)) AS BIGINT) AS m FROM near{k} n JOIN parts x ON x.r = n.r AND x.p = n.p CROSS JOIN range(1, {_SIZE} + 1) t(j) GROUP BY 1, 2, 3) q GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)"""


ORACLES["op11_vector_codes"] = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * {_SIZE} + 1:(p + 1) * {_SIZE}] AS v FROM kept CROSS JOIN range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, CAST(r - 1 AS INTEGER) AS e, v FROM parts WHERE r <= 64),
{_round_sql(0)},
{_round_sql(1)},
near2 AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT x.r, x.p, y.e, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN book2 y ON y.p = x.p) q GROUP BY 1, 2),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN digest
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLES["op12_ranked_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, {_TERMS}) AS w FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) q GROUP BY 1, 2),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS HUGEINT) AS total FROM d WHERE len(w) > 0),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf CROSS JOIN s GROUP BY t, s.docs),
q AS (SELECT b, item_id, t, count(*) AS n FROM (SELECT row_number() OVER () AS b, item_id, unnest(regexp_extract_all({_LOW}, {_TERMS})) AS t FROM benchmark) x GROUP BY 1, 2, 3),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(w) AS HUGEINT) * s.docs) // s.total AS m FROM d CROSS JOIN s WHERE len(w) > 0),
f AS (SELECT q.b, q.item_id, m.r, m.doc_id, CAST(sum(q.n * weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN weights USING (t) JOIN tf USING (t) JOIN m ON m.r = tf.r GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) x WHERE rank <= 10
"""


@query
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_minhash_near_dedup"] = _linked_sql(2, 80, ", coalesce(d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)), TRUE) AS kept")


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
