"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter has blocks of eight 64-bit words; a canonical URL sets one bit in each word of its one block. It comes
from the listed URLs by an aggregate over words, has a bounded size and reaches the scan as a scalar; URLs that
pass it are possible hits, and an exact hash join with the list removes the false ones. With more listed URLs than
its size is meant for more false hits reach the join, with the same result.

A URL's host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, lower-cased (A-Z); its path from there to
``?``, ``#`` or the end. Null URLs and those without ``://`` have both empty, match no rule and are never listed.
A rule ``host/path`` fits its host and all subdomains where the path starts with the rule's; the longest wins.
Repeated rows are judged alike; an empty list lists nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.tables import written

#: Fixed values: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

WORDS_PER_BLOCK = 8
BITS_PER_URL = 16
#: 64 bytes each: the filter is 16 MB at most.
MOST_BLOCKS = 1 << 18
#: Up to so many listed URLs are broadcast to the exact join; more are shuffled, in SALTS parts per URL.
BROADCAST_URLS = 100_000
SALTS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"^(?:utm_[a-z]+|ref|gclid|fbclid)(?:=|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last ``/`` or ``.html``, query without tracking; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    asked = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)), "&")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def _fits(host: Column, path: Column, rule: str) -> Column:
    of_host, _, of_path = rule.partition("/")
    return ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(f"/{of_path}")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        fits = _fits(host, path, text)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def blocks_for(n_urls: int) -> int:
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * WORDS_PER_BLOCK * 64 < n_urls * BITS_PER_URL:
        blocks *= 2
    return blocks


def _places(url: str, n_blocks: int) -> tuple[str, list[str]]:
    """SQL of a URL's block and of its bit in each word."""
    bits = f"xxhash64('bits', {url})"
    return f"cast(pmod(xxhash64({url}), {n_blocks}) as int)", [f"cast(shiftright({bits}, {6 * w}) & 63 as int)" for w in range(WORDS_PER_BLOCK)]


def bloom_words(listed: DataFrame, n_blocks: int) -> DataFrame:
    """One row with the filter: the words of all blocks as an array of n_blocks * 8 longs."""
    block, bits = _places("url", n_blocks)
    marks = ", ".join(f"struct({block} * {WORDS_PER_BLOCK} + {w} as word, shiftleft(1L, {bit}) as mask)" for w, bit in enumerate(bits))
    set_bits = listed.select(F.expr(f"inline(array({marks}))"))
    unset = listed.sparkSession.range(n_blocks * WORDS_PER_BLOCK).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = set_bits.union(unset).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words"))


def may_be_listed(url: str, words: Column, n_blocks: int) -> Column:
    block, bits = _places(url, n_blocks)
    tests = [
        F.get(words, F.expr(f"{block} * {WORDS_PER_BLOCK} + {w}")).bitwiseAND(F.expr(f"shiftleft(1L, {bit})")) != 0 for w, bit in enumerate(bits)
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _confirmed(tested: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """``tested`` with a flag ``listed``: an exact join of the possible hits on the canonical URL.

    A short list is broadcast to one reading of all rows, of which only possible hits have a key. With a longer one only
    possible hits are shuffled, each URL's rows in several parts.
    """
    marked = listed.select(F.col("url").alias("_key"), F.lit(True).alias("listed"))
    if n_listed <= BROADCAST_URLS:
        return tested.withColumn("_key", F.when(F.col("_possible"), F.col("canonical_url"))).join(F.broadcast(marked), "_key", "left")
    hits = tested.filter("_possible")
    parts = listed.select(F.col("url").alias("canonical_url"), F.lit(True).alias("listed"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("page_id", "raw_url"), F.lit(SALTS)).cast("int"))
    found = salted.join(parts, ["canonical_url", "_salt"], "left").drop("_salt")
    return tested.filter("not _possible").withColumn("listed", F.lit(False)).unionByName(found)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical_url, listed) of each row of ``pages``.

    ``listed`` has canonical URLs in ``url``. The verdict is the rule's; without one, block where the URL is listed.
    """
    listed = written(listed.select("url").filter("url is not null").distinct(), "listed")
    n_listed = listed.count()
    n_blocks = blocks_for(n_listed)
    words = bloom_words(listed, n_blocks).scalar()
    url = F.col("url")
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("raw_url"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url")
    )
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "_says": says})
    possible = F.coalesce(F.col("rule").isNull() & may_be_listed("canonical_url", words, n_blocks), F.lit(False))
    tested = ruled.withColumn("_possible", possible)
    names = ["page_id", "raw_url", "host", "path", "canonical_url", "rule", "_says"]
    both = _confirmed(tested.select(*names, "_possible"), listed, n_listed).select(*names, F.coalesce("listed", F.lit(False)).alias("listed"))
    verdict = F.coalesce("_says", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical_url", "listed")


#: Second-level names whose pages are reported as unwanted.
UNWANTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_HIDDEN = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"


def unwanted(html: Column) -> Column:
    """One in ten or more of the shown characters is one of ``#*$%``; false for nothing shown."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    chars = F.regexp_count(shown, F.lit(r"[^\x20\x09-\x0D]"))
    return (chars > 0) & (10 * F.regexp_count(shown, F.lit("[#*$%]")) >= chars)


def reported(pages: DataFrame, names: Sequence[str] = UNWANTED_NAMES) -> DataFrame:
    """(url): canonical URLs of pages (url, html) whose content is unwanted or whose host has one of the names as a label.

    The content is evidence that no URL shows: through its canonical URL it reaches every other variant of the page.
    """
    labels = F.split(host_of(F.col("url")), r"\.")
    return pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, names))) | unwanted(F.col("html"))).select(canonical(F.col("url")).alias("url"))
