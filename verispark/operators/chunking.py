"""Articles to sections, paragraphs, sentences and overlapping sentence windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.functions.text import compute_once, count_tokens, section_slug, split_sentences, strip
from verispark.operators.ordered import keep_first

INTRO = "Wprowadzenie"  # fixed value: title of the text before the first heading
MAX_SENT = 3
MAX_TOKENS = 256
OVERLAP = 1
_FOLD_BLOCK = 256


def sections_of(text: Column) -> Column:
    """Array of (section_title, body). Blocks are parted by three or more line breaks."""
    blocks = F.split(text, "\n{3,}")

    def one(block: Column, i: Column) -> Column:
        t = strip(block)
        first_line = strip(F.substring_index(t, "\n", 1))
        body = strip(F.regexp_replace(t, r"^[^\n]*\n?", ""))
        return F.struct(
            F.when(i == 0, F.lit(INTRO)).otherwise(first_line).alias("section_title"),
            F.when(i == 0, t).otherwise(body).alias("body"),
        )

    return F.filter(F.transform(blocks, one), lambda s: s["body"] != "")


def paragraphs_of(body: Column) -> Column:
    """Paragraphs of a section: parted by one empty line, blank ones dropped."""
    return F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: p != "")


def parse_sections(articles: DataFrame) -> DataFrame:
    """(page_id, title, section_index, section_title, body); section_index counts kept sections."""
    parts = F.posexplode(sections_of(F.col("text"))).alias("section_index", "s")
    return articles.select("page_id", "title", parts).select(
        "page_id", "title", "section_index", F.col("s.section_title").alias("section_title"), F.col("s.body").alias("body")
    )


def split_paragraphs(articles: DataFrame) -> DataFrame:
    """One row per paragraph with its 0-based index in the section."""
    return parse_sections(articles).select(
        "page_id",
        "title",
        "section_index",
        "section_title",
        F.posexplode(paragraphs_of(F.col("body"))).alias("paragraph_index", "paragraph"),
    )


def article_sentences(articles: DataFrame) -> DataFrame:
    """One row per sentence with every index that says where it stood."""
    return split_paragraphs(articles).select(
        "page_id",
        "title",
        "section_index",
        "section_title",
        "paragraph_index",
        F.posexplode(split_sentences(F.col("paragraph"))).alias("sentence_index", "text"),
    )


def _window_sums(counts: Column, i: Column, max_sent: int) -> list[Column]:
    """Tokens of the first 1, 2, .. max_sent sentences from `i`; NULL past the end."""
    sums = [F.get(counts, i)]
    for j in range(1, max_sent):
        sums.append(sums[-1] + F.get(counts, i + j))
    return sums


def window_sizes(counts: Column, max_sent: int, max_tokens: int) -> Column:
    """Greedy window size at every sentence. Counts are not negative, so sizes follow from sums."""

    def size(_: Column, i: Column) -> Column:
        more = [F.coalesce(s <= max_tokens, F.lit(False)).cast("int") for s in _window_sums(counts, i, max_sent)[1:]]
        return sum(more, F.lit(1))

    return F.transform(counts, size)


def window_starts(sizes: Column, overlap: int) -> Column:
    """Starts reached from sentence 0: each window begins `overlap` before the end of the last.

    A fold that carries only the next start. It runs in blocks, so that growing the result
    costs a copy of the kept starts per block only.
    """

    def state(nxt: Column, kept: Column) -> Column:
        return F.struct(nxt.alias("next"), kept.alias("kept"))

    none = F.array().cast("array<int>")

    def visit(acc: Column, i: Column) -> Column:
        step = F.greatest(F.get(sizes, i) - max(overlap, 0), F.lit(1))
        return F.when(i == acc["next"], state(i + step, F.array_append(acc["kept"], i))).otherwise(acc)

    def block(acc: Column, at: Column) -> Column:
        places = F.sequence(at, F.least(at + (_FOLD_BLOCK - 1), F.size(sizes) - 1))
        # The block's result is added as one array per block.
        return F.aggregate(
            places,
            state(acc["next"], none),
            visit,
            lambda r: state(r["next"], F.concat(acc["kept"], r["kept"])),
        )

    blocks = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(_FOLD_BLOCK))
    return F.when(F.size(sizes) > 0, F.aggregate(blocks, state(F.lit(0), none), block)["kept"])


def build_chunks(
    articles: DataFrame,
    max_sent: int = MAX_SENT,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    drop_tail: bool = False,
    splitter: Callable[[Column], Column] = split_sentences,
    counter: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """Chunk table of a table of articles (page_id, title, text).

    All work on an article stays in its row, so nothing is shuffled. `drop_tail` leaves out a
    window that only repeats the end of the one before it. `splitter` cuts a paragraph into sentences
    (an array), `counter` counts a sentence's tokens, for limits of another model.
    """
    # One id part per section: a title goes to Python there, and no chunk has to wait for it.
    sections = parse_sections(articles).withColumn("slug", section_slug(F.col("section_title")))
    paras = sections.select("page_id", "title", "section_index", "section_title", "slug",
                            F.posexplode(paragraphs_of(F.col("body"))).alias("paragraph_index", "paragraph"))
    cut = compute_once(paras, "sentences", splitter(F.col("paragraph"))).drop("paragraph")
    sized = compute_once(cut, "counts", F.transform("sentences", lambda s: counter(s).cast("int")))
    sized = compute_once(sized, "sizes", window_sizes(F.col("counts"), max_sent, max_tokens))
    started = compute_once(sized, "starts", window_starts(F.col("sizes"), overlap))
    if drop_tail:
        started = started.withColumn(
            "starts", F.filter("starts", lambda i: (i == 0) | (i + max(overlap, 0) < F.size("sizes")))
        )

    def window(i: Column) -> Column:
        size = F.get("sizes", i)
        sums = _window_sums(F.col("counts"), i, max_sent)
        texts = [F.when(size > j, F.get("sentences", i + j)) for j in range(max_sent)]
        return F.struct(
            i.alias("start"),
            size.alias("size"),
            F.coalesce(*[F.when(size == j + 1, t) for j, t in enumerate(sums)]).cast("int").alias("tokens"),
            F.concat_ws(" ", *texts).alias("text"),
        )

    # The text is put together before the rows are split, so no row carries the whole paragraph.
    rows = compute_once(started, "wins", F.transform("starts", window)).select(
        "page_id", "title", "section_index", "section_title", "slug", "paragraph_index", F.posexplode("wins").alias("chunk_index", "w"))
    return rows.select(
        F.concat_ws("_", F.col("page_id").cast("string"), "slug", F.col("paragraph_index").cast("string"),
                    F.col("chunk_index").cast("string")).alias("chunk_id"),
        "page_id",
        "title",
        "section_index",
        "section_title",
        "paragraph_index",
        "chunk_index",
        F.sequence(F.col("w.start"), F.col("w.start") + F.col("w.size") - 1).alias("sentence_indices"),
        F.col("w.text").alias("text"),
        F.col("w.tokens").alias("num_tokens"),
    )


def chunk_id_collisions(chunks: DataFrame) -> DataFrame:
    """Chunk ids given to more than one chunk of a page."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")


def mark_articles(articles: DataFrame, stored: DataFrame, order: list[Column | str]) -> DataFrame:
    """First line of every page_id with its `status`: skipped (stored), blank or new."""
    first = keep_first(articles, ["page_id"], order)
    done = stored.select("page_id").distinct().withColumn("_done", F.lit(1))
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    return (
        first.join(done, "page_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_done").isNotNull(), "skipped").when(blank, "blank").otherwise("new"),
        )
        .drop("_done")
    )


def pending_articles(articles: DataFrame, stored: DataFrame, order: list[Column | str], limit: int | None = None) -> DataFrame:
    """Articles still to be chunked. `limit` counts new and skipped ones together, in `order`."""
    marked = mark_articles(articles, stored, order)
    if limit is not None:
        marked = marked.filter("status <> 'blank'").orderBy(*order).limit(limit)
    return marked.filter("status = 'new'").drop("status")


def ingest_counters(marked: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: new, skipped and blank articles, and chunks made."""
    def n(s):
        return F.count(F.when(F.col("status") == s, 1))

    arts = marked.agg(n("new").alias("articles_new"), n("skipped").alias("articles_skipped"),
                      n("blank").alias("articles_blank"))
    made = chunks.select("chunk_id").distinct().agg(F.count("*").alias("chunks_inserted"))
    return arts.crossJoin(made)  # one row each
