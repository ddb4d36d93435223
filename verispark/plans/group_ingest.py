"""Queries over readers, writers, claim records and web pages (groups A and B).

Reader and writer queries write the given tables to the shared folder and read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.operators import claims as cl
from verispark.operators import pages as pg
from verispark.operators.chunking import build_chunks
from verispark.operators.embedding import embed_chunks
from verispark.operators.ordered import keep_first
from verispark.plans.group_chunking import WINDOW_CTES
from verispark.plans.registry import query
from verispark.session import cut_lineage, fresh_path
from verispark.sources import readers as rd
from verispark.sources import writers as wr
from verispark.sources.tables import scan_preset
from verispark.views import table, view

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _statements(spark, sf_dir):
    rows = view(spark, sf_dir, "v_statements")
    return rows.withColumn("tags", F.filter(F.split("tag_text", r"\|"), lambda t: t != "")).drop("tag_text")


# ---- readers and writers -------------------------------------------------------------------


@query("read_claims_csv", "SELECT question, answers, correct_answer_index, name, year, type FROM v_exam")
def _(spark, sf_dir):
    path = fresh_path(spark, "exam-csv")
    rows = view(spark, sf_dir, "v_exam").select(*rd.CLAIM_CSV)
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rd.read_claims_csv(spark, path)


@query(
    "read_claims_json",
    "SELECT CAST(id AS VARCHAR) AS id, statement, person_name, person_function, publication_date, rating, detail_url, category, array_to_string(list_filter(string_split(tag_text, '|'), lambda t: t <> ''), '|') AS tags FROM v_statements",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "statements-json")
    rows = _statements(spark, sf_dir)
    # Files of some hundred records each: one JSON array per line of text, one line per file group.
    record = F.to_json(F.struct(*[F.col("id").cast("string").alias("id"), *[c for c in rows.columns if c != "id"]]))
    files = 1 + rows.count() // 500
    arrays = rows.withColumn("_f", F.pmod(F.xxhash64("id"), F.lit(files))).groupBy("_f").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.repartition(files, "_f").select("_f", "value").write.partitionBy("_f").text(path)
    got = rd.read_claims_json(spark, f"{path}/*")
    cols = ("id", "statement", "person_name", "person_function", "publication_date", "rating", "detail_url", "category")
    return got.select(*cols, F.array_join("tags", "|").alias("tags"))


def _article_lines(spark, sf_dir, path):
    arts = view(spark, sf_dir, "v_articles")
    line = F.to_json(F.struct(
        F.col("page_id").alias("pageid"), "title", "text", F.length("text").cast("bigint").alias("content_length"),
        F.array("lang", "source").alias("categories")))
    value = (
        F.when(F.col("source") == "src3", F.concat(F.substring(line, 1, 20), F.lit(" ...")))
        .when(F.col("source") == "src4", F.concat(F.lit("\n"), line)).otherwise(line))
    arts.select(value.alias("value")).write.text(path)


@query(
    "read_articles_jsonl",
    "SELECT page_id AS pageid, title, text, CAST(length(text) AS BIGINT) AS content_length, concat(lang, ',', source) AS categories FROM v_articles WHERE source <> 'src3'",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "articles")
    _article_lines(spark, sf_dir, path)
    got = rd.read_articles_jsonl(spark, path)
    return got.select("pageid", "title", "text", "content_length", F.array_join("categories", ",").alias("categories"))


@query("bad_articles", "SELECT count(*) AS n FROM v_articles WHERE source = 'src3'")
def _(spark, sf_dir):
    path = fresh_path(spark, "articles")
    _article_lines(spark, sf_dir, path)
    return rd.bad_articles(spark, path).agg(F.count("*").alias("n"))


_CHUNK_COLS = ("chunk_id", "page_id", "title", "section_title", "paragraph_index", "text", "num_tokens")


def _chunks(spark, sf_dir):
    return build_chunks(view(spark, sf_dir, "v_articles"))


@query("write_chunks_jsonl", f"SELECT {', '.join(_CHUNK_COLS)}, sentence_indices, 16 AS dim FROM chunks", WINDOW_CTES)
def _(spark, sf_dir):
    path = fresh_path(spark, "chunks")
    vectors = embed_chunks(_chunks(spark, sf_dir), dim=16)
    wr.write_chunks_jsonl(vectors.drop("section_index", "chunk_index"), path)
    got = rd.read_chunks_jsonl(spark, path)
    return got.select(*_CHUNK_COLS, F.array_join("sentence_indices", ",").alias("sentence_indices"), F.size("embedding").alias("dim"))


@query("read_chunks_jsonl", f"SELECT {', '.join(_CHUNK_COLS)} FROM chunks", WINDOW_CTES)
def _(spark, sf_dir):
    path = fresh_path(spark, "chunks")
    wr.write_chunks_jsonl(_chunks(spark, sf_dir).drop("section_index", "chunk_index"), path)
    return rd.read_chunks_jsonl(spark, path).select(*_CHUNK_COLS)


@query("jsonl_to_csv", """SELECT CAST(page_id AS VARCHAR) AS pageid, title, text, concat('["', lang, '","', source, '"]') AS categories FROM v_articles""")
def _(spark, sf_dir):
    source, target = fresh_path(spark, "articles"), fresh_path(spark, "articles-csv")
    arts = view(spark, sf_dir, "v_articles")
    arts.select(F.col("page_id").alias("pageid"), "title", "text", F.array("lang", "source").alias("categories")).write.json(source)
    wr.jsonl_to_csv(spark, source, target, rd.ARTICLE)
    got = rd.read_claims_csv(spark, target, tuple(f.name for f in rd.ARTICLE.fields))
    return got.select("pageid", "title", "text", "categories")


@query("scan_preset", "SELECT id, claim_text, label, label_original, topic, claim_date, metadata FROM v_claims")
def _(spark, sf_dir):
    return scan_preset(spark, "am_benchmark", tables={"claims": view(spark, sf_dir, "v_claims")})


@query(
    "scan_preset_chunks",
    f"SELECT {', '.join(_CHUNK_COLS)} FROM chunks",
    WINDOW_CTES,
)
def _(spark, sf_dir):
    path = fresh_path(spark, "wiki-chunks")
    _chunks(spark, sf_dir).write.parquet(path)
    return scan_preset(spark, "wiki_chunks", paths={"wiki_chunks": path})


# Stored chunks: all pages but the French ones. The batch: new versions of German and Spanish pages, and the French ones.
_LAYERS = """
lay AS (SELECT c.*, a.lang FROM chunks c JOIN v_articles a ON a.page_id = c.page_id),
pool AS (SELECT chunk_id, num_tokens, title, section_index, 0 AS layer, lang FROM lay WHERE lang <> 'fr'
  UNION ALL SELECT chunk_id, num_tokens, concat(title, ' v2'), section_index, 1, lang FROM lay WHERE lang <> 'en'),
"""


def _layers(spark, sf_dir):
    langs = view(spark, sf_dir, "v_articles").select("page_id", "lang")
    rows = cut_lineage(_chunks(spark, sf_dir).join(langs, "page_id").select("chunk_id", "num_tokens", "title", "section_index", "lang"))
    target = rows.filter("lang <> 'fr'")
    batch = rows.filter("lang <> 'en'").withColumn("title", F.concat("title", F.lit(" v2")))
    return target, batch


@query(
    "upsert_chunks",
    "SELECT chunk_id, num_tokens, title, section_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY layer DESC, section_index DESC) AS rn FROM pool) WHERE rn = 1",
    WINDOW_CTES + _LAYERS,
)
def _(spark, sf_dir):
    target, batch = _layers(spark, sf_dir)
    target = keep_first(target, ["chunk_id"], [F.col("section_index").desc()])  # a stored table has one row per id
    return wr.upsert_chunks(target, batch, ["section_index"]).select("chunk_id", "num_tokens", "title", "section_index")


@query(
    "append_new_chunks",
    """SELECT chunk_id, num_tokens, title, section_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY section_index) AS rn FROM pool WHERE layer = 1)
WHERE rn = 1 AND chunk_id NOT IN (SELECT chunk_id FROM pool WHERE layer = 0)""",
    WINDOW_CTES + _LAYERS,
)
def _(spark, sf_dir):
    target, batch = _layers(spark, sf_dir)
    return wr.append_new_chunks(target, batch, ["section_index"]).select("chunk_id", "num_tokens", "title", "section_index")


@query("export_results_csv", "SELECT CAST(id AS VARCHAR) AS id, agent_name, CAST(claim_id AS VARCHAR) AS claim_id, model_label, raw_output FROM v_results")
def _(spark, sf_dir):
    path = fresh_path(spark, "results-csv")
    cols = ("id", "agent_name", "claim_id", "model_label", "raw_output")
    wr.export_results_csv(view(spark, sf_dir, "v_results").select(*cols), path)
    return rd.read_claims_csv(spark, path, cols)


@query("replace_by_source", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'again' ELSE 'first' END AS load, source FROM documents WHERE NOT (source = 'src2' AND lang = 'en')")
def _(spark, sf_dir):
    path = fresh_path(spark, "claims-by-source")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    wr.replace_by_source(docs.withColumn("load", F.lit("first")), path)
    again = docs.filter("source IN ('src1', 'src2') AND NOT (source = 'src2' AND lang = 'en')")
    wr.replace_by_source(again.withColumn("load", F.lit("again")), path)
    return spark.read.parquet(path).select("doc_id", "load", "source")


# ---- claim records -------------------------------------------------------------------------


@query(
    "map_fields",
    """SELECT CAST(id AS VARCHAR) AS external_id, statement AS claim_text, person_name AS speaker, person_function AS speaker_role, publication_date AS claim_date, rating AS label_original,
  CAST(NULL AS VARCHAR) AS topic, detail_url AS url, concat_ws('|', category, reading_time) AS rest FROM v_statements""",
)
def _(spark, sf_dir):
    out = cl.map_fields(_statements(spark, sf_dir).drop("tags"), cl.STATEMENT_FIELDS)
    return out.withColumn("rest", F.concat_ws("|", "remainder.category", "remainder.reading_time")).drop("remainder")


def _sql_meta(pairs) -> str:
    parts = ", ".join(f"CASE WHEN {v} <> '' THEN concat('\"{k}\":', CAST(to_json({v}) AS VARCHAR)) END" for k, v in pairs)
    return f"CASE WHEN concat_ws(',', {parts}) <> '' THEN concat('{{', concat_ws(',', {parts}), '}}') END"


@query("pack_metadata", f"SELECT id, {_sql_meta([('category', 'category'), ('reading_time', 'reading_time')])} AS metadata FROM v_statements")
def _(spark, sf_dir):
    rows = _statements(spark, sf_dir)
    return rows.select("id", cl.pack_metadata({"category": F.col("category"), "reading_time": F.col("reading_time")}).alias("metadata"))


@query("drop_blank_claims", f"SELECT doc_id FROM v_exam WHERE trim(question, {WS}) <> ''")
def _(spark, sf_dir):
    return cl.drop_blank_claims(view(spark, sf_dir, "v_exam"), "question").select("doc_id")


@query("blank_counts", f"SELECT count(*) AS n_read, count(*) FILTER (trim(question, {WS}) <> '') AS n_kept, count(*) FILTER (trim(question, {WS}) = '') AS n_skipped FROM v_exam")
def _(spark, sf_dir):
    return cl.blank_counts(view(spark, sf_dir, "v_exam"), "question")


@query(
    "assign_external_id",
    f"SELECT doc_id, CAST(rn - 1 AS VARCHAR) AS external_id FROM (SELECT doc_id, question, row_number() OVER (ORDER BY doc_id) AS rn FROM v_exam) WHERE trim(question, {WS}) <> ''",
)
def _(spark, sf_dir):
    numbered = cl.assign_external_id(view(spark, sf_dir, "v_exam"), ["doc_id"])
    return cl.drop_blank_claims(numbered, "question").select("doc_id", "external_id")


_LABEL_SQL = f"CASE lower(trim(coalesce(rating, ''), {WS})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cl.STATEMENT_LABELS.items()) + " ELSE 'NOT_ENOUGH_INFO' END"


@query("normalize_label", f"SELECT id, {_LABEL_SQL} AS label, 'SUPPORTS' AS exam_label FROM v_statements")
def _(spark, sf_dir):
    rating = F.col("rating")
    return view(spark, sf_dir, "v_statements").select(
        "id", cl.normalize_label(rating).alias("label"), cl.normalize_label(rating, cl.EXAM_LABELS, "SUPPORTS").alias("exam_label"))


_DAY = "split_part(trim(split_part(publication_date, 'godz.', 1)), ' ', 1)"
_DATE_SQL = f"CASE WHEN publication_date <> '' THEN CASE WHEN len(string_split({_DAY}, '.')) = 3 THEN concat(split_part({_DAY}, '.', 3), '-', split_part({_DAY}, '.', 2), '-', split_part({_DAY}, '.', 1)) ELSE publication_date END END"


@query("parse_pl_date", f"SELECT id, {_DATE_SQL} AS claim_date FROM v_statements")
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_statements").select("id", cl.parse_pl_date(F.col("publication_date")).alias("claim_date"))


@query("join_tags", "SELECT id, CASE WHEN tag_text <> '' THEN replace(tag_text, '|', ', ') END AS topic FROM v_statements")
def _(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", cl.join_tags(F.col("tags")).alias("topic"))


@query(
    "claims_from_exams",
    f"""SELECT 'am_benchmark' AS source, CAST(rn - 1 AS VARCHAR) AS external_id, question AS claim_text, nullif(trim(coalesce(year, '')), '') AS claim_date, 'SUPPORTS' AS label, correct_answer_index AS label_original, name AS topic,
  {_sql_meta([('answers', 'answers'), ('correct_answer_index', 'correct_answer_index'), ('exam_type', 'type'), ('doc_id', "CAST(doc_id AS VARCHAR)")])} AS metadata
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM v_exam) WHERE trim(question, {WS}) <> ''""",
)
def _(spark, sf_dir):
    return cl.claims_from_exams(view(spark, sf_dir, "v_exam"), ["doc_id"]).drop("speaker", "speaker_role", "url")


@query(
    "claims_from_statements",
    f"""SELECT 'demagog' AS source, CAST(id AS VARCHAR) AS external_id, statement AS claim_text, person_name AS speaker, person_function AS speaker_role, {_DATE_SQL} AS claim_date, {_LABEL_SQL} AS label,
  trim(coalesce(rating, ''), {WS}) AS label_original, CASE WHEN tag_text <> '' THEN replace(tag_text, '|', ', ') END AS topic, detail_url AS url FROM v_statements WHERE statement <> ''""",
)
def _(spark, sf_dir):
    return cl.claims_from_statements(_statements(spark, sf_dir)).drop("metadata")


@query(
    "claim_distributions",
    f"""SELECT 'label' AS kind, label AS value, count(*) AS n FROM (SELECT {_LABEL_SQL} AS label FROM v_statements) GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'topic', topic, count(*) AS n FROM (SELECT CASE WHEN tag_text <> '' THEN replace(tag_text, '|', ', ') END AS topic FROM v_statements) WHERE topic IS NOT NULL GROUP BY 2 ORDER BY n DESC, topic LIMIT 10)""",
)
def _(spark, sf_dir):
    rows = _statements(spark, sf_dir).select(cl.normalize_label(F.col("rating")).alias("label"), cl.join_tags(F.col("tags")).alias("topic"))
    labels = cl.label_counts(rows).select(F.lit("label").alias("kind"), F.col("label").alias("value"), "n")
    topics = cl.top_topics(rows.filter("topic IS NOT NULL"))
    return labels.unionByName(topics.select(F.lit("topic").alias("kind"), F.col("topic").alias("value"), "n"))


@query(
    "question_with_answers",
    """SELECT id, CASE WHEN json_valid(metadata) THEN concat(claim_text, chr(10), chr(10), 'Odpowiedzi:', chr(10), '0: A', id, chr(10), '1: B', chr(10), '2: C', chr(10), '3: D') ELSE claim_text END AS question FROM v_claims""",
)
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_claims").select("id", cl.question_with_answers(F.col("claim_text"), F.col("metadata")).alias("question"))


@query("ground_truth_label", "SELECT id, coalesce(nullif(lo, ''), label) AS truth, label AS truth_plain FROM (SELECT id, label, CASE WHEN id % 5 = 0 THEN '' WHEN id % 7 = 0 THEN NULL ELSE label_original END AS lo FROM v_claims)")
def _(spark, sf_dir):
    lo = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("label_original"))
    return view(spark, sf_dir, "v_claims").select(
        "id", cl.ground_truth_label(F.col("label"), lo).alias("truth"), cl.ground_truth_label(F.col("label")).alias("truth_plain"))


# ---- web pages -----------------------------------------------------------------------------

LINK_CTES = """
links AS (SELECT page_id, url AS base, ls, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS ls FROM pages)),
link AS (SELECT page_id, i - 1 AS pos, concat(regexp_extract(base, '^(https?://[^/]+)', 1), regexp_extract(ls[i], 'href="([^"]*)"', 1)) AS url, trim(regexp_extract(ls[i], '">([^<]*)</a>', 1)) AS title FROM links),
listing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM link) WHERE rn = 1),
"""


def _listing(spark, sf_dir):
    return pg.extract_listing(table(spark, sf_dir, "pages"), pg.MENU_SELECTORS)


@query("extract_listing", "SELECT page_id, CAST(pos AS INTEGER) AS pos, url, title FROM listing", LINK_CTES)
def _(spark, sf_dir):
    return _listing(spark, sf_dir).select("page_id", "pos", "url", "title")


# Character references of the pages back to their signs, `&` last. HTML reads these without the semicolon too, as in a title that
# was cut inside one; a number cut to a control sign stands for nothing.
_NUMBER_END = "(?:;|([^0-9A-Fa-f;])|$)"
_REFERENCES = (("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&quot;?", "chr(34)"), (f"&#x27{_NUMBER_END}", r"chr(39) || '\1'"),
               (f"&#x2{_NUMBER_END}", r"'\1'"), ("&amp;?", "'&'"))
_UNESCAPED = "{}"
for _reference, _sign in _REFERENCES:
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '{_reference}', {_sign}, 'g')"
_TITLE = "trim(" + _UNESCAPED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ")"
_MENU = _UNESCAPED.format("array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), '<a href=\"[^\"]*\">([^<]*)</a>', 1), ', ')")


@query(
    "extract_detail",
    f"""SELECT page_id, url AS detail_url, {_TITLE} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {_MENU} AS tags,
  true AS has_text, true AS no_person FROM pages""",
)
def _(spark, sf_dir):
    rows = pg.extract_detail(table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id", "detail_url", "title", "lang", F.array_join("tags", ", ").alias("tags"),
        (F.col("summary").isNotNull() & F.col("full_analysis").isNotNull()).alias("has_text"), F.col("person_name").isNull().alias("no_person"))


# Listed: every menu link and the address of every page in English.
_WANTED = "(SELECT url FROM listing UNION SELECT url FROM pages WHERE html LIKE '%<html lang=\"en\">%')"


def _detailed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    english = pages.filter(F.col("html").contains('<html lang="en">')).select("url")
    listed = _listing(spark, sf_dir).select("url").union(english)
    details = keep_first(pages.select("page_id", F.col("url").alias("detail_url")), ["detail_url"], ["page_id"])
    return pg.listing_to_detail(listed, details)


_DETAILED = f"SELECT w.url AS detail_url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'page not found' END AS error FROM {_WANTED} w LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = w.url"


@query("listing_to_detail", _DETAILED, LINK_CTES)
def _(spark, sf_dir):
    return _detailed(spark, sf_dir)


@query("detail_counts", f"SELECT count(*) FILTER (error IS NULL) AS ok_count, count(error) AS err_count FROM ({_DETAILED})", LINK_CTES)
def _(spark, sf_dir):
    return pg.detail_counts(_detailed(spark, sf_dir))
