"""Listing and detail rows out of raw web pages.

A page is parsed inside its own row with the standard HTML parser; everything after that
(first per url, joins, counts) is done on columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispark.operators.ordered import keep_first

VOID = {"br", "img", "meta", "link", "hr", "input", "source", "wbr"}
_SKIP = {"script", "style"}


class _Reader(HTMLParser):
    """Elements as paths of (tag, classes, number), and the texts below each element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple] = []
        self.texts: dict[tuple, list[str]] = {}
        self.tags: list[tuple[tuple, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        step = (tag, tuple((found.get("class") or "").split()))
        # The serial number makes every element its own node.
        node = (*step, len(self.tags))
        self.tags.append(((*self.path, node), found))
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        self.tags.append(((*self.path, (tag, tuple((found.get("class") or "").split()), len(self.tags))), found))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not any(s[0] in _SKIP for s in self.path):
            for node in self.path:
                self.texts.setdefault(node, []).append(text)



def _matches(node: tuple, want: str) -> bool:
    """`tag`, `.class` or `tag.class`."""
    tag, _, cls = want.partition(".")
    return (not tag or node[0] == tag) and (not cls or cls in node[1])


def _find(tags: list, selector: str) -> list[tuple[tuple, dict]]:
    """Elements for a selector of steps with blanks between them (descendants)."""
    steps = selector.split()
    out = []
    for path, attrs in tags:
        if not _matches(path[-1], steps[-1]):
            continue
        left = list(steps[:-1])
        for node in reversed(path[:-1]):
            if left and _matches(node, left[-1]):
                left.pop()
        if not left:
            out.append((path, attrs))
    return out


class Page:
    """One parsed page: first element, all elements, text and attribute of an element."""

    def __init__(self, html: str, within: tuple | None = None, reader: _Reader | None = None) -> None:
        if reader is None:
            reader = _Reader()
            reader.feed(html or "")
            reader.close()
        self._reader = reader
        self._tags = [t for t in reader.tags if within is None or within in t[0]]

    def all(self, selector: str) -> list[tuple[tuple, dict]]:
        return _find(self._tags, selector)

    def first(self, *selectors: str) -> tuple[tuple, dict] | None:
        for s in selectors:
            found = self.all(s)
            if found:
                return found[0]
        return None

    def text(self, element: tuple[tuple, dict] | None, glue: str = "") -> str | None:
        return None if element is None else glue.join(self._reader.texts.get(element[0][-1], []))

    def part(self, element: tuple[tuple, dict]) -> Page:
        return Page("", within=element[0][-1], reader=self._reader)


LISTING_FIELDS = ("title", "url", "person", "rating", "snippet")
_LISTING = T.ArrayType(T.StructType(
    [T.StructField(c, T.StringType()) for c in LISTING_FIELDS] + [T.StructField("tags", T.ArrayType(T.StringType()))]))

# Selectors of a listing page; the second set serves plain pages with a menu.
LISTING_SELECTORS = {
    "items": (".dg-item--desktop", ".dg-item"),
    "link": (".dg-item__title a", ".dg-itemtitle a"),
    "person": (".dg-item__person a", ".dg-itemperson a"),
    "rating": (".dg-item__evaluation p", ".dg-itemevaluation p"),
    "snippet": (".dg-item__description", ".dg-itemdescription"),
    "tags": (".dg-item__tags", ".dg-itemtags"),
}
MENU_SELECTORS = {**LISTING_SELECTORS, "items": ("nav li",), "link": ("a",)}

# Selectors of a detail page.
DETAIL_TEXTS = {
    "title": (".dg-post-content__title--desktop h2", ".dg-post-content__title h2"),
    "category": (".dg-post-content__category span",),
    "person_name": (".dg-post-person .dg-post-person__desc h4 a",),
    "person_function": (".dg-post-person .dg-post-person__function",),
    "person_party": (".dg-post-person .dg-post-person__party",),
    "statement": (".dg-post-quote__statement",),
    "statement_source": (".dg-post-quote__footer--desktop .dg-post-quote__source", ".dg-post-quote__source"),
    "rating": (".dg-post-quote__footer--desktop .dg-post-quote__evaluation p", ".dg-post-quote__evaluation p"),
}
# Selectors of plain article pages, used after the ones above.
PLAIN_TEXTS = {"title": ("h1",), "category": ("h2",), "summary": ("article p",), "full_analysis": ("article p", "p")}
DETAIL_FIELDS = (
    "title", "publication_date", "reading_time", "category", "person_name", "person_function", "person_party",
    "person_image_url", "statement", "statement_source", "statement_source_url", "rating", "summary", "full_analysis", "lang",
)
_DETAIL = T.StructType(
    [T.StructField(c, T.StringType()) for c in DETAIL_FIELDS] + [T.StructField("tags", T.ArrayType(T.StringType()))])


def listing_items(html: str, base: str, selectors: dict) -> list[dict]:
    page = Page(html)
    for s in selectors["items"]:
        items = page.all(s)
        if items:
            break
    out = []
    for item in items:
        part = page.part(item)
        link = part.first(*selectors["link"])
        if link is None:
            continue
        href = link[1].get("href")
        tags = part.first(*selectors["tags"])
        out.append({
            "title": part.text(link), "url": urljoin(base, href) if href else None,
            **{f: part.text(part.first(*selectors[f])) for f in ("person", "rating", "snippet")},
            "tags": [part.text(a) for a in part.part(tags).all("a")] if tags else [],
        })
    return out


def detail_fields(html: str) -> dict:
    page = Page(html)
    got = {f: page.text(page.first(*DETAIL_TEXTS.get(f, ()), *PLAIN_TEXTS.get(f, ()))) for f in DETAIL_FIELDS}
    info = page.first(".dg-post__info--desktop", ".dg-post__info")
    spans = page.part(info).all("span") if info else []
    got["publication_date"] = page.text(spans[0]) if spans else None
    got["reading_time"] = page.text(spans[1]) if len(spans) > 1 else None
    image = page.first(".dg-post-person .dg-post-person__image img")
    got["person_image_url"] = image[1].get("src") if image else None
    source = page.first(*DETAIL_TEXTS["statement_source"])
    link = page.part(source).first("a") if source else None
    got["statement_source_url"] = link[1].get("href") if link else None
    summary = page.first(".summary-text", *PLAIN_TEXTS["summary"])
    got["summary"] = page.text(summary, "\n")
    blocks = page.all(".dg-post-content__inner") or page.all("article p") or page.all("p")
    whole = [t for t in (page.text(b, "\n") for b in blocks) if t]
    got["full_analysis"] = "\n\n".join(whole) if whole else None
    root = page.first("html")
    got["lang"] = root[1].get("lang") if root else None
    tags = page.first(".dg-post-content__tags--desktop", ".dg-post-content__tags", "nav")
    got["tags"] = [page.text(a) for a in page.part(tags).all("a")] if tags else []
    return got


def extract_listing(pages: DataFrame, selectors: dict = LISTING_SELECTORS) -> DataFrame:
    """(page_id, pos, title, url, person, rating, snippet, tags); the first item per url of a page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = [listing_items(h, u or "", selectors) for h, u in zip(b["html"], b["url"])]
            yield pd.DataFrame({"page_id": b["page_id"].to_numpy(), "items": items})

    schema = T.StructType([pages.schema["page_id"], T.StructField("items", _LISTING)])
    read_rows = pages.select("page_id", "url", "html").mapInPandas(read, schema)
    rows = read_rows.select("page_id", F.posexplode("items").alias("pos", "i")).select("page_id", "pos", "i.*")
    return keep_first(rows, ["page_id", "url"], ["pos"])


def extract_detail(pages: DataFrame) -> DataFrame:
    """One row per page with the fifteen fields, the tags and `detail_url`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([detail_fields(h) for h in b["html"]], columns=[f.name for f in _DETAIL.fields])
            yield pd.concat([b[["page_id", "url"]].rename(columns={"url": "detail_url"}).reset_index(drop=True), rows], axis=1)

    schema = T.StructType([pages.schema["page_id"], T.StructField("detail_url", T.StringType()), *_DETAIL.fields])
    return pages.select("page_id", "url", "html").mapInPandas(read, schema)


def listing_to_detail(listing: DataFrame, details: DataFrame) -> DataFrame:
    """One row per listed url, numbered by the caller; urls without a page keep an `error`."""
    wanted = listing.filter(F.col("url").isNotNull()).select(F.col("url").alias("detail_url")).distinct()
    got = details.withColumn("_ok", F.lit(1))
    return wanted.join(got, "detail_url", "left").withColumn(
        "error", F.when(F.col("_ok").isNull(), F.lit("page not found"))).drop("_ok")


def detail_counts(details: DataFrame) -> DataFrame:
    return details.agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("ok_count"), F.count("error").alias("err_count"))
