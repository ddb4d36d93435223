"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.llm import chat, collocations, decontam, dual_tree, embed_dedup, langid, licences, ngram_join, packing, quality, token_counts, url_filter, whitening
from verispark.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The rules of the query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs whose own canonical form more than one page has (mirrors of one page)."""
    pages = table(spark, sf_dir, "pages")
    key = url_filter.canonical(F.col("url"))
    mirrored = pages.filter("url IS NOT NULL").groupBy(key.alias("_k")).agg(F.count_distinct("url").alias("_n"), F.min("url").alias("url")).filter("_n > 1")
    return url_filter.filter_urls(pages, mirrored, URL_RULES)


ORACLES["op5_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda k: k <> '' AND NOT regexp_matches(k, '^(utm_[a-z]+|ref|fbclid|gclid|session|sid)=')) AS keys
  FROM pages),
named AS (
  SELECT page_id, url, host, path, CASE WHEN host <> '' THEN
    concat(regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', ''), regexp_replace(path, '(/index)?\.html?$|/+$', ''),
      CASE WHEN len(keys) > 0 THEN concat('?', array_to_string(list_sort(keys), '&')) ELSE '' END) END AS canonical
  FROM parts),
listed AS (SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT url) > 1),
judged AS (
  SELECT page_id, host, path, canonical, canonical IN (SELECT canonical FROM listed) AS listed,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  canonical, coalesce(listed, false) AS listed
FROM judged
"""


@query
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.chat_digest(chat.format_chats(rows.unionByName(extra)))


ORACLES["op4_chat_windows"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
    len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')) + 4 AS n,
    length('<turn><turn-text></turn>') + 1 + length(role) + length(text) + length(role) - length(replace(role, '\', ''))
      + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(role, '</?turn')) + len(regexp_extract_all(text, '</?turn')) AS chars
  FROM rows_),
lead_ AS (SELECT conv_id, n AS sys_n, chars AS sys_chars FROM numbered WHERE pos = 0 AND role = 'system'),
summed AS (
  SELECT t.*, sys_n, sys_chars, pos = 0 AND sys_n IS NOT NULL AS is_lead, CASE WHEN pos = 0 AND sys_n IS NOT NULL THEN 0 ELSE n END AS tok,
    sum(CASE WHEN pos = 0 AND sys_n IS NOT NULL THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY pos) AS e,
    greatest(2048 - 512 - coalesce(sys_n, 0), 512) AS room
  FROM numbered t LEFT JOIN lead_ USING (conv_id)),
placed AS (SELECT *, e - tok AS s, floor((e - tok) / room) AS a, floor(greatest(e - 1, e - tok) / room) AS b FROM summed),
windows AS (SELECT conv_id, a, b, min(s) AS s0, min(pos) AS p0, max(sys_chars) AS sys_chars FROM placed GROUP BY ALL),
repeated AS (
  SELECT conv_id, sys_chars AS chars FROM windows WHERE p0 > 0 AND sys_chars IS NOT NULL
  UNION ALL
  SELECT w.conv_id, t.chars FROM windows w JOIN placed t ON t.conv_id = w.conv_id AND NOT t.is_lead AND t.pos < w.p0 AND t.s >= w.s0 - 512 AND t.tok <= 512
  UNION ALL SELECT conv_id, chars FROM placed),
chars AS (SELECT conv_id, sum(chars) AS formatted_chars FROM repeated GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
  CAST(any_value(formatted_chars) AS BIGINT) AS formatted_chars
FROM numbered JOIN chars USING (conv_id) GROUP BY conv_id
"""


@query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


_ITEMS = ", ".join(f"('{licence}', '{rule}', {n}, {k}, '{s}')" for licence, rule, n, k, s in licences.rule_items(licences.LICENCES))
ORACLES["op3_licence_scan"] = r"""
WITH items(licence, rule, n, k, sentence) AS (VALUES """ + _ITEMS + r"""),
forms AS (
  SELECT doc_id, 'line' AS form, string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \t\r\n]+', concat('\1', chr(1)), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'wrapped', string_split(regexp_replace(regexp_replace(text, '([.!?;:])[ \t\r\n]+', concat('\1', chr(1)), 'g'), '\n[ \t\r]*\n+', chr(1), 'g'), chr(1)) FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, form, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM forms),
found AS (
  SELECT doc_id, form, pos, licence, rule, n, k FROM units JOIN items
  ON trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = sentence),
per_rule AS (
  SELECT doc_id, form, licence, rule, min(pos) AS first_pos, max(pos) AS last_pos,
    list_reduce(list_prepend({'k': 0, 'n': 0}, list({'k': k, 'n': n} ORDER BY pos, k DESC)),
      lambda state, x: {'k': CASE WHEN x.k <> state.k % 1000 + 1 THEN state.k WHEN x.k = x.n THEN state.k - state.k % 1000 + 1000 ELSE state.k + 1 END, 'n': 0}).k // 1000 AS n_passages
  FROM found GROUP BY ALL),
per_form AS (SELECT doc_id, form, licence, sum(n_passages) AS n, min(first_pos) AS f, max(last_pos) AS l FROM per_rule WHERE n_passages > 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY n DESC, form = 'line' DESC, f DESC, l DESC) AS rn FROM per_form)
SELECT doc_id, licence, CAST(n AS BIGINT) AS n_matches, CAST(f AS INTEGER) AS first_sentence, CAST(l AS INTEGER) AS last_sentence FROM best WHERE rn = 1
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.withColumn("edits", token_counts.scrub_edits(F.col("text"), F.col("doc_id")))
    return token_counts.edited_token_counts(edited, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return dual_tree.top_k(rows, rows.filter("vec_id % 50 = 0"))


ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common WHERE 100 * c >= 80 * (an + bn - c)
  UNION ALL SELECT b, a FROM common WHERE 100 * c >= 80 * (an + bn - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM sets LEFT JOIN least_ ON doc_id = a
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, doc_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM cut CROSS JOIN (VALUES (1), (2), (3), (4)) s(k)),
totals AS (SELECT lang, sum(len(w)) AS n FROM cut GROUP BY lang),
counts AS (SELECT lang, k, phrase, count(*) AS f, min(doc_id) AS first_doc FROM runs GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, k, f AS a, first_doc, w, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT x.lang, x.phrase, a, x.first_doc, c, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts x JOIN counts h ON h.lang = x.lang AND h.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN counts t ON t.lang = x.lang AND t.phrase = array_to_string(x.w[x.c + 1:x.k], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, f, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM candidates, unnest(range(2, k)) q(m), unnest(range(1, k - m + 2)) p(s) WHERE k > 2),
around AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN around o USING (lang, phrase) WHERE 100 * coalesce(o.f, 0) < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score, first_doc
FROM kept JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op13_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN least_ ON least_.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
