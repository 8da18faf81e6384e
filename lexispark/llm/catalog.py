"""Queries of the operators: name -> (function of spark and folder, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import collocations, decontaminate, embed_dedup, jaccard_join, kd_shards, langid, lm_score, merkle, packing, span_dedup, tool_calls, toxicity, url_filter
from lexispark.llm.shared import read_table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return keep


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


#: Host and path rules of the URL filter (fixed by its contract).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host with a label of this form puts its pages on the list of canonical URLs.
LISTED_HOST = r"(^|\.)(spam|cheap)-"

_HOST = "translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '')"
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_WHEN = [(v, h + p, _FITS.format(h=h, p=p)) for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
_OP6_SQL = f"""
WITH split AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
canon AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/+)$', '') END AS canonical_url FROM split),
listed AS (SELECT DISTINCT canonical_url AS u FROM canon WHERE regexp_matches(host, '(^|\\.)(spam|cheap)-'))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r}'" for _, r, f in _WHEN)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for v, _, f in _WHEN)} WHEN u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  canonical_url, u IS NOT NULL AS by_list
FROM canon LEFT JOIN listed ON canonical_url = u"""


@register("op6_url_filter", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOST)).select(url_filter.canonical(host, path).alias("canonical_url"))
    return url_filter.judge(pages, listed, URL_RULES)


@register("op10_kd_tree_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(read_table(spark, sf_dir, "documents"), shards=8)


@register("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"), k=3, percent=90)


@register("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.remove_repeats(docs).select("doc_id", "n_removed", "text")


_OP9_WORDS = "list_filter(string_split_regex(regexp_replace(lower(text), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', ' ', 'g'), ' +'), lambda x: x <> '')"
_OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_OP9_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS s FROM i),
n AS (SELECT item_id, count(*) AS item_shingles FROM ish GROUP BY 1),
dsh AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS s
        FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
SELECT doc_id, item_id, item_shingles, count(*) AS shared FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
GROUP BY 1, 2, 3 HAVING count(*) * 100 >= item_shingles * 80"""


@register("op9_benchmark_decontamination", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items).select("doc_id", "item_id", "item_shingles", "shared")


_OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.c, vec_id) AS component_id, vec_id = coalesce(low.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""


@register("op1_embedding_near_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


#: Tools whose calls are made of the turns of ``conversations``, and their parameters.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("measure", "text", "string", True), ("measure", "exact", "boolean", True), ("measure", "ratio", "number", False),
    ("quote", "source", "string", True), ("quote", "text", "string", True),
]


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of conversation turns: an assistant turn calls a tool with its
    text, after the call two turns before; the user turn that follows is its result."""
    ident = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    n, pick = F.length("text"), F.length("text") % 4
    arguments = (
        F.when(pick == 0, F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit"))))
        .when(pick == 1, F.to_json(F.struct(F.col("text"), (n / 8).alias("ratio"), (n > 200).alias("exact"))))
        .when(pick == 2, F.to_json(F.struct(F.col("text"), F.col("role").alias("source"), n.alias("size"))))
        .otherwise(F.to_json(F.struct(n.cast("string").alias("limit"), F.array(F.col("role"), F.col("text")).alias("query"))))
    )
    name = F.when(pick == 1, "measure").when(pick == 2, "quote").otherwise("search")
    calls = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after"))
    results = turns.where("role = 'user' and turn > 0").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


_OP7_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(text) AS n, length(text) % 4 AS p FROM conversations),
calls AS (SELECT conv_id, 'c' || turn AS call_id, turn, CASE p WHEN 1 THEN 'measure' WHEN 2 THEN 'quote' ELSE 'search' END AS name,
  CASE p WHEN 0 THEN '{"limit":' || n || ',"query":' || to_json(text) || '}'
    WHEN 1 THEN '{"exact":' || (n > 200)::VARCHAR || ',"ratio":' || CASE WHEN n % 8 = 0 THEN (n // 8)::VARCHAR ELSE (n / 8)::VARCHAR END || ',"text":' || to_json(text) || '}'
    WHEN 2 THEN '{"size":' || n || ',"source":' || to_json(role) || ',"text":' || to_json(text) || '}'
    ELSE '{"limit":"' || n || '","query":[' || to_json(role) || ',' || to_json(text) || ']}' END AS args,
  CASE p WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [] WHEN 2 THEN ['unknown:size'] ELSE ['type:limit', 'type:query'] END AS own,
  CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS after, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM t WHERE role = 'assistant'),
call AS (SELECT * EXCLUDE (nth) FROM calls WHERE nth = 1),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, turn, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM t WHERE role = 'user' AND turn > 0),
res AS (SELECT * EXCLUDE (nth) FROM results WHERE nth = 1),
d AS (SELECT c.conv_id, c.call_id, 0::BIGINT AS depth FROM call c LEFT JOIN call p ON p.conv_id = c.conv_id AND p.call_id = c.after WHERE p.call_id IS NULL
  UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM d JOIN call c ON c.conv_id = d.conv_id AND c.after = d.call_id),
x AS (SELECT c.*, d.depth, r.content, r.call_id IS NOT NULL AS has, CASE WHEN c.after IS NOT NULL AND d.depth = 0 THEN ['after:missing'] ELSE []::VARCHAR[] END || own AS errors
  FROM call c JOIN d USING (conv_id, call_id) LEFT JOIN res r USING (conv_id, call_id))
SELECT conv_id, call_id, turn, name, CASE WHEN has THEN 'linked' ELSE 'no_result' END AS status, depth, len(errors) = 0 AS valid, errors,
  '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":' || args || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"name":"' || name
  || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS line FROM x
UNION ALL
SELECT conv_id, call_id, turn, NULL, 'orphan_result', NULL, NULL, NULL, '{"call_id":"' || call_id || '","conv_id":' || conv_id || ',"result":' || to_json(content) || '}'
FROM res ANTI JOIN call USING (conv_id, call_id)
UNION ALL
SELECT conv_id, call_id, turn, name, 'duplicate_call', NULL, false, ['duplicate:call_id'] || own, '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":' || args || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"name":"' || name || '","result":null}'
FROM calls WHERE nth > 1
UNION ALL
SELECT conv_id, call_id, turn, NULL, 'duplicate_result', NULL, NULL, NULL, '{"call_id":"' || call_id || '","conv_id":' || conv_id || ',"result":' || to_json(content) || '}'
FROM results WHERE nth > 1"""


@register("op7_tool_call_linking", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turn_calls(read_table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return tool_calls.link(calls, results, schemas)


@register("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.stupid_backoff(read_table(spark, sf_dir, "documents"), order=3)


@register("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEAF = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: The checksum's steps: a byte is added, then eight halvings follow.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""
_OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF(f"translate(text, {_ABC})")} ELSE {_LEAF("text")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid FROM d),
up AS (SELECT source, 0 AS lev, list(leaf ORDER BY pos) AS l FROM p GROUP BY source
  UNION ALL SELECT source, lev + 1, [sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], '')) for i in range(0, (len(l) + 15) // 16)] FROM up WHERE len(l) > 1),
sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM up WHERE len(l) = 1),
top AS (SELECT 0 AS lev, list(subroot ORDER BY spos) AS l FROM sub
  UNION ALL SELECT lev + 1, [sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], '')) for i in range(0, (len(l) + 15) // 16)] FROM top WHERE len(l) > 1),
lv AS (SELECT rid, lev AS o, l, pos // (16 ** lev)::BIGINT AS j FROM p JOIN up ON p.source IS NOT DISTINCT FROM up.source WHERE len(l) > 1
  UNION ALL SELECT rid, 100 + lev, l, spos // (16 ** lev)::BIGINT FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN top ON len(l) > 1),
beside AS (SELECT rid, o, array_to_string(l[j // 16 * 16 + 1:j], '') AS b, array_to_string(l[j + 2:j // 16 * 16 + 16], '') AS a FROM lv),
proof AS (SELECT rid, sha256(string_agg(b || a, '' ORDER BY o)) AS proof, list({{'b': b, 'a': a}} ORDER BY o) AS steps FROM beside GROUP BY rid),
fold AS (SELECT rid, 1 AS i, tampered AS node, steps FROM p LEFT JOIN proof USING (rid)
  UNION ALL SELECT rid, i + 1, sha256(steps[i].b || node || steps[i].a), steps FROM fold WHERE i <= len(steps))
SELECT doc_id, p.source AS source_key, pos AS position, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, coalesce(len(proof.steps), 0) AS siblings, node AS folded_root, node = root AS verified
FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source LEFT JOIN proof USING (rid) JOIN fold USING (rid), (SELECT l[1] AS root FROM top WHERE len(l) = 1)
WHERE fold.i = 1 + coalesce(len(proof.steps), 0)"""


@register("op12_merkle_manifest", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


_OP13_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_ABC}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS s FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, s, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, s, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS s FROM c WHERE k = 3) GROUP BY ALL),
cut AS (SELECT c.*, j FROM c ANTI JOIN longer ON c.k = 2 AND c.lang = longer.lang AND c.s = longer.s AND 100 * most >= 50 * a, (VALUES (1), (2)) v(j) WHERE j < k),
score AS (SELECT cut.lang, cut.s, a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM cut
  JOIN f l ON l.lang = cut.lang AND l.s = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = cut.lang AND r.s = array_to_string(w[j + 1:3], ' ')),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN n USING (lang)
QUALIFY rank <= 2000"""


@register("op13_phrase_collocations", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), max_words=3, least=10, percent=50, top=2000)
