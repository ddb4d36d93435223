"""URL filters with column functions only.

Listed canonical URLs go into a blocked Bloom filter: a table with one 64-bit word per block, where each URL sets
four bits of one word. A URL whose bits are not all set is certainly not listed. Only possible hits go on to an exact
hash join with the list, which removes the false positives. Host and path rules are a small fixed table and come
before the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
BROADCAST_BYTES = 8 << 20
_WORD_BYTES = 48  # one block's row in a broadcast table
_TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|session|sid)="  # fixed values: query keys that do not change the page


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(_split(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return _split(url, 2)


def _split(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, `www.`/`m.` prefix, default port, `index.html`/`.html` endings, closing slashes, tracking keys and fragment dropped."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    p = F.regexp_replace(path(url), r"(/index)?\.html?$|/+$", "")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    keys = F.array_sort(F.filter(F.split(query, "&"), lambda k: (k != "") & ~k.rlike(_TRACKING)))
    return F.concat(h, p, F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise(""))


def _bits(h: Column) -> Column:
    """Four bits of a 64-bit word, from four parts of the hash."""
    parts = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12, 18)]
    word = parts[0]
    for part in parts[1:]:
        word = word.bitwiseOR(part)
    return word


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(29))


def bloom_blocks(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, word) rows of the filter over distinct keys, and the number of blocks."""
    n = max(1, -(-listed.select(key).distinct().count() * BITS_PER_URL // 64))
    h = _hash(F.col(key))
    return listed.groupBy(F.pmod(F.shiftright(h, 24), F.lit(n)).alias("_block")).agg(F.bit_or(_bits(h)).alias("_word")), n


def rule_verdict(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (host, path, verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id",
    url_col: str = "url", listed_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed for every row of `pages`.

    The verdict is the longest fitting rule's; without one, `block` for a listed canonical URL and `allow` otherwise.
    A null URL or one without `://` has an empty host and path, fits no rule and is never listed. Nulls in the list
    are ignored; repeated rows give repeated results; an empty list allows all that no rule blocks; other columns
    are ignored. The filter is sent to every task while its size, which is known from the count, stays below
    `broadcast_bytes`; beyond that it is joined by block, where skewed blocks are split by the engine.
    """
    url = F.col(url_col).cast("string")
    asked = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), F.when(host(url) != "", canonical(url)).alias("_key"))
    names = listed.select(F.col(listed_col).cast("string").alias("_url")).filter(host(F.col("_url")) != "")
    names = names.select(canonical(F.col("_url")).alias("_key")).distinct()
    blocks, n = bloom_blocks(names, "_key")
    if n * _WORD_BYTES <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    h = _hash(F.col("_key"))
    marked = asked.withColumn("_block", F.when(F.col("_key").isNotNull(), F.pmod(F.shiftright(h, 24), F.lit(n))))
    marked = marked.join(blocks, "_block", "left")
    possible = F.coalesce(F.col("_word").bitwiseAND(_bits(h)) == _bits(h), F.lit(False))
    # Only possible hits carry a key into the exact join; a null key meets nothing and is never moved for long.
    marked = marked.withColumn("_try", F.when(possible, F.col("_key")))
    hits = marked.filter("_try IS NOT NULL").join(names.withColumnRenamed("_key", "_listed"), F.col("_try") == F.col("_listed"), "left")
    both = hits.withColumn("listed", F.col("_listed").isNotNull()).drop("_listed").unionByName(marked.filter("_try IS NULL").withColumn("listed", F.lit(False)))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select(F.col(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("_key").alias("canonical"), "listed")
