"""Queries over article parsing and chunking (group C and the article part of B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.functions.text import count_tokens, section_slug, split_sentences
from verispark.operators import articles as art
from verispark.operators import chunking as ch
from verispark.plans.registry import query
from verispark.views import table, view

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(133) || chr(8195) || chr(8201) || chr(8239) || chr(12288)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_sentences(x: str) -> str:
    marked = f"regexp_replace({sql_strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_slug(x: str) -> str:
    body = f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN {body} = '' THEN 'untitled' ELSE {body} END"


CHUNK_CTES = f"""
blocks AS (SELECT page_id, title, bs, generate_subscripts(bs, 1) AS i FROM (SELECT page_id, title, regexp_split_to_array(text, '\\n{{3,}}') AS bs FROM v_articles)),
block AS (SELECT page_id, title, i, {sql_strip('bs[i]')} AS t FROM blocks),
sec0 AS (SELECT page_id, title, i, CASE WHEN i = 1 THEN 'Wprowadzenie' ELSE {sql_strip("split_part(t, chr(10), 1)")} END AS section_title,
  CASE WHEN i = 1 THEN t WHEN strpos(t, chr(10)) = 0 THEN '' ELSE {sql_strip("substr(t, strpos(t, chr(10)) + 1)")} END AS body FROM block),
sec AS (SELECT page_id, title, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS section_index, section_title, body FROM sec0 WHERE body <> ''),
para0 AS (SELECT page_id, title, section_index, section_title, ps, generate_subscripts(ps, 1) AS i
  FROM (SELECT *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '') AS ps FROM sec)),
para AS (SELECT page_id, title, section_index, section_title, CAST(i - 1 AS INTEGER) AS paragraph_index, ps[i] AS paragraph FROM para0),
sent0 AS (SELECT page_id, title, section_index, section_title, paragraph_index, {sql_sentences('paragraph')} AS ss FROM para),
sent AS (SELECT page_id, title, section_index, section_title, paragraph_index, CAST(i - 1 AS INTEGER) AS sentence_index, ss[i] AS text
  FROM (SELECT *, generate_subscripts(ss, 1) AS i FROM sent0)),
"""

# Greedy windows as a recursive walk over the paragraphs.
WINDOW_CTES = (
    CHUNK_CTES
    + """
cnt AS (SELECT page_id, title, section_index, section_title, paragraph_index, ss,
  list_transform(ss, lambda s: CAST(len(regexp_extract_all(s, '\\S+')) AS INTEGER)) AS c FROM sent0 WHERE len(ss) > 0),
fit AS (SELECT page_id, section_index, paragraph_index, i - 1 AS start,
  CASE WHEN i + 1 <= len(c) AND c[i] + c[i + 1] <= 256 THEN CASE WHEN i + 2 <= len(c) AND c[i] + c[i + 1] + c[i + 2] <= 256 THEN 3 ELSE 2 END ELSE 1 END AS size, len(c) AS n
  FROM (SELECT *, generate_subscripts(c, 1) AS i FROM cnt)),
walk(page_id, section_index, paragraph_index, start, size, k) AS (
  SELECT page_id, section_index, paragraph_index, start, size, 0 FROM fit WHERE start = 0
  UNION ALL
  SELECT f.page_id, f.section_index, f.paragraph_index, f.start, f.size, w.k + 1 FROM walk w JOIN fit f
    ON f.page_id = w.page_id AND f.section_index = w.section_index AND f.paragraph_index = w.paragraph_index AND f.start = w.start + greatest(w.size - 1, 1)),
"""
    + f"""
chunks AS (SELECT concat_ws('_', CAST(c.page_id AS VARCHAR), {sql_slug('c.section_title')}, CAST(c.paragraph_index AS VARCHAR), CAST(w.k AS VARCHAR)) AS chunk_id,
  c.page_id, c.title, c.section_index, c.section_title, c.paragraph_index, CAST(w.k AS INTEGER) AS chunk_index,
  array_to_string(range(CAST(w.start AS BIGINT), CAST(w.start + w.size AS BIGINT)), ',') AS sentence_indices,
  array_to_string(c.ss[CAST(w.start AS BIGINT) + 1 : CAST(w.start + w.size AS BIGINT)], ' ') AS text,
  CAST(list_sum(c.c[CAST(w.start AS BIGINT) + 1 : CAST(w.start + w.size AS BIGINT)]) AS INTEGER) AS num_tokens
  FROM walk w JOIN cnt c USING (page_id, section_index, paragraph_index)),
"""
)


def chunks_of(spark, sf_dir):
    return ch.build_chunks(view(spark, sf_dir, "v_articles"))


def flat(chunks):
    return chunks.withColumn("sentence_indices", F.array_join("sentence_indices", ","))


@query("parse_sections", "SELECT page_id, section_index, section_title, body FROM sec", CHUNK_CTES)
def _(spark, sf_dir):
    return ch.parse_sections(view(spark, sf_dir, "v_articles")).drop("title")


@query("split_paragraphs", "SELECT page_id, section_index, section_title, paragraph_index, paragraph FROM para", CHUNK_CTES)
def _(spark, sf_dir):
    return ch.split_paragraphs(view(spark, sf_dir, "v_articles")).drop("title")


@query("split_sentences", f"SELECT doc_id, i AS pos, ss[i] AS sentence FROM (SELECT doc_id, ss, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, {sql_sentences('text')} AS ss FROM documents))")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = docs.select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("p", "sentence"))
    return cut.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "sentence")


@query("article_sentences", "SELECT page_id, title, section_index, section_title, paragraph_index, sentence_index, text FROM sent", CHUNK_CTES)
def _(spark, sf_dir):
    return ch.article_sentences(view(spark, sf_dir, "v_articles"))


@query("count_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS num_tokens FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("num_tokens"))


@query(
    "chunk_windows",
    """SELECT page_id, section_index, paragraph_index, CAST(k AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size FROM walk""",
    WINDOW_CTES,
)
def _(spark, sf_dir):
    c = chunks_of(spark, sf_dir)
    return c.select(
        "page_id", "section_index", "paragraph_index", "chunk_index",
        F.element_at("sentence_indices", 1).alias("start"), F.size("sentence_indices").alias("size"),
    )


@query("section_slug", f"SELECT word, {sql_slug('word')} AS slug FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", section_slug(F.col("word")).alias("slug"))


@query("build_chunks", "SELECT * FROM chunks", WINDOW_CTES)
def _(spark, sf_dir):
    return flat(chunks_of(spark, sf_dir))


@query("chunk_id_collisions", "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1", WINDOW_CTES)
def _(spark, sf_dir):
    return ch.chunk_id_collisions(chunks_of(spark, sf_dir))


# Stored already: the pages of one language. The article feed repeats the pages of one source.
_FEED = "(SELECT page_id, title, text, lang, 1 AS line FROM v_articles UNION ALL SELECT page_id, title, text, lang, 2 AS line FROM v_articles WHERE source = 'src1')"


def feed(spark, sf_dir):
    arts = view(spark, sf_dir, "v_articles")
    again = arts.filter("source = 'src1'").withColumn("line", F.lit(2))
    return arts.withColumn("line", F.lit(1)).unionByName(again).drop("source")


@query(
    "pending_articles",
    f"""SELECT page_id, lang, line FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line) AS rn FROM {_FEED})
WHERE rn = 1 AND lang <> 'en' AND trim(text) <> ''""",
)
def _(spark, sf_dir):
    stored = view(spark, sf_dir, "v_articles").filter("lang = 'en'")
    return ch.pending_articles(feed(spark, sf_dir), stored, [F.col("line")]).select("page_id", "lang", "line")


@query(
    "ingest_counters",
    """SELECT (SELECT count(*) FROM v_articles WHERE lang <> 'en' AND trim(text) <> '') AS articles_new,
  (SELECT count(*) FROM v_articles WHERE lang = 'en') AS articles_skipped,
  (SELECT count(*) FROM v_articles WHERE lang <> 'en' AND trim(text) = '') AS articles_blank,
  (SELECT count(DISTINCT chunk_id) FROM chunks WHERE page_id IN (SELECT page_id FROM v_articles WHERE lang <> 'en')) AS chunks_inserted""",
    WINDOW_CTES,
)
def _(spark, sf_dir):
    stored = view(spark, sf_dir, "v_articles").filter("lang = 'en'")
    marked = ch.mark_articles(feed(spark, sf_dir), stored, [F.col("line")])
    return ch.ingest_counters(marked, ch.build_chunks(marked.filter("status = 'new'")))


# ---- article rows -------------------------------------------------------------------------

# Parts of one page: every conversation is a page, every turn one part of its answer.
@query(
    "merge_paged_articles",
    """SELECT conv_id AS pageid, array_to_string(list(role || ':' || turn ORDER BY turn), '|') AS links,
  arg_max(text, turn) AS extract, CAST(max(turn) AS BIGINT) AS length FROM conversations WHERE NOT (role = 'system') GROUP BY conv_id""",
)
def _(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    parts = conv.select(
        F.col("conv_id").alias("pageid"), "turn", (F.col("role") == "system").alias("missing"),
        F.array(F.concat("role", F.lit(":"), F.col("turn").cast("string"))).alias("links"),
        F.col("text").alias("extract"), F.col("turn").alias("length"),
    )
    out = art.merge_paged_articles(parts, "pageid", "turn", ["links"], ["extract", "length"])
    return out.withColumn("links", F.array_join("links", "|"))


@query(
    "article_details",
    """SELECT a.page_id AS pageid, a.title, length(a.text) AS content_length, CAST(coalesce(l.n, 0) AS INTEGER) AS number_of_references, coalesce(c.cats, '') AS categories
FROM v_articles a LEFT JOIN (SELECT page_id, len(regexp_extract_all(html, 'href="')) AS n FROM pages) l ON a.page_id = l.page_id
LEFT JOIN (SELECT doc_id, concat('q', quality, ',', 't', toxic) AS cats FROM labels) c ON a.page_id = c.doc_id""",
)
def _(spark, sf_dir):
    main = view(spark, sf_dir, "v_articles").select(
        F.col("page_id").alias("pageid"), "title", F.length("text").cast("bigint").alias("content_length"))
    links = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pageid"), F.regexp_extract_all("html", F.lit('href="'), 0).alias("extlinks"))
    cats = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pageid"),
        F.array(F.concat(F.lit("Kategoria: q"), "quality"), F.concat(F.lit("Kategoria: t"), "toxic")).alias("categories"))
    return art.article_details(main, links, cats).withColumn("categories", F.array_join("categories", ","))


def _sql_url(x: str) -> str:
    out = f"url_encode(replace({x}, ' ', '_'))"
    for c in art.URL_SAFE:
        out = f"replace({out}, '%{ord(c):02X}', '{c}')"
    return f"concat('{art.WIKI_URL}', {out})"


@query("article_url", f"SELECT page_id, title, {_sql_url('title')} AS url FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return t.select("page_id", "title", art.article_url(F.col("title")).alias("url"))


@query(
    "dedup_articles",
    f"""SELECT page_id, lang, line, row_number() OVER (ORDER BY page_id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line) AS rn FROM {_FEED}) WHERE rn = 1""",
)
def _(spark, sf_dir):
    rows = feed(spark, sf_dir).select("page_id", "lang", "line")
    return art.dedup_articles(rows, "page_id", [F.col("page_id"), F.col("line")])


@query(
    "dedup_counts",
    f"SELECT count(*) AS n_lines, count(DISTINCT page_id) AS n_kept, count(*) - count(DISTINCT page_id) AS n_duplicates FROM {_FEED}",
)
def _(spark, sf_dir):
    out = art.dedup_counts(feed(spark, sf_dir), "page_id")
    return out.select([F.col(c).cast("bigint") for c in out.columns])
