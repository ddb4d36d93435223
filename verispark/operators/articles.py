"""Raw encyclopedia pages to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.functions.text import strip
from verispark.operators.ordered import keep_first, with_ordinal

CATEGORY_PREFIX = "Kategoria:"  # fixed value
WIKI_URL = "https://pl.wikipedia.org/wiki/"  # fixed value
URL_SAFE = "/:@!$&()*+,;="  # fixed value: characters left as they are


def merge_paged_articles(pages: DataFrame, key: str, page_no: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Answers that came in several parts: lists are joined in part order, the last scalar wins.

    Rows flagged `missing` are dropped. One article's parts meet in one row, which is also the
    size of the result.
    """
    kept = pages.filter(~F.coalesce(F.col("missing"), F.lit(False)))
    joined = [
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(page_no, F.col(c).alias("v"))))),
                lambda s: s["v"],
            )
        ).alias(c)
        for c in lists
    ]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(page_no))).alias(c) for c in scalars]
    return kept.groupBy(key).agg(*joined, *last)


def article_details(main: DataFrame, links: DataFrame, cats: DataFrame) -> DataFrame:
    """Article rows with the number of references and plain category names; 0 and [] by default."""
    refs = links.select("pageid", F.size("extlinks").alias("_refs"))
    names = cats.select(
        "pageid",
        F.transform("categories", lambda c: strip(F.replace(c, F.lit(CATEGORY_PREFIX), F.lit("")))).alias("_cats"),
    )
    return (
        main.join(refs, "pageid", "left")
        .join(names, "pageid", "left")
        .withColumn("number_of_references", F.coalesce("_refs", F.lit(0)))
        .withColumn("categories", F.coalesce("_cats", F.array().cast("array<string>")))
        .drop("_refs", "_cats")
    )


def article_url(title: Column) -> Column:
    """Address of an article: blanks to `_`, percent codes except for the safe characters."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for ch in URL_SAFE:
        # `*` is never coded by url_encode
        if ch != "*":
            coded = F.replace(coded, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.concat(F.lit(WIKI_URL), F.replace(coded, F.lit("%7E"), F.lit("~")))


def dedup_articles(articles: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """First row per page, survivors numbered from 1 in `order`."""
    return with_ordinal(keep_first(articles, [key], order), order, name="id", start=1)


def dedup_counts(articles: DataFrame, key: str) -> DataFrame:
    """One row: lines read, pages kept, duplicates dropped."""
    per = articles.groupBy(key).agg(F.count("*").alias("_n"))
    return per.agg(
        F.sum("_n").alias("n_lines"), F.count("*").alias("n_kept"), (F.sum("_n") - F.count("*")).alias("n_duplicates")
    )
