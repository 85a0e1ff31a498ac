"""URL filter: fixed host rules first, mined association rules for the rest.

Frequent combinations of URL tokens are mined with Spark's FP-growth over the
labelled pages; rules that conclude "bad" and pass support and confidence form
an inverted index from their rarest token to the rule. A page is compared only
with the rules that one of its tokens leads to.

Tokens that stand in the same labelled pages are one item, so a long template
counts once, not with all its subsets; an item fits a page that has any of its
tokens, as every one of them makes the same rules. Items too rare among bad
pages can be in no rule and are left out before mining. Where a labelled page
holds more than ``WIDEST`` items, FP-growth would list up to 2 ** items sets of
it; there the sets are grown level by level instead, without those that a
smaller set replaces. All items of all pages are mined, and the rules fit the
same pages with the same confidence. All pages are judged by all rules.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import staged
from recordloom.session import small_side

# Host and path of each rule, and its verdict. A rule holds for all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD = "label=bad"
# Least number of labelled pages of a rule, beside the relative support, and
# items of one labelled page up to which FP-growth lists all their sets.
LEAST_PAGES, WIDEST = 5, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?`` or ``#``; empty without ``://`` or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: what follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fixed rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host, its parent domains, path words, extension and query keys.

    Words of digits only name single pages and are left out.
    """
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    steps = F.filter(F.split(path, r"[/._-]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([^:/?#]*)://", 1)
    named = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(f"{kind}="), w))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)), parents, named("path", steps), named("query", keys)
    ))


def items_of(marked: DataFrame, least: int, share_bad: float) -> DataFrame:
    """``token``, its ``item``, in how many pages it stands and how typical of bad ones that is.

    Tokens of equal rows (by number and two checksums) share the item named by
    the smallest of them. ``marked`` holds ``page``, ``bad`` and ``tokens``.
    """
    each = marked.select("page", "bad", F.explode("tokens").alias("token"))
    rows = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("bad").cast("long")).alias("bads"),
        F.bit_xor(F.xxhash64("page")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "page")).alias("two"),
    )
    same = ["pages", "bads", "one", "two"]
    rows = staged(rows.where(F.col("bads") >= least), "url-tokens")
    names = rows.groupBy(*same).agg(F.min("token").alias("item"))
    lift = F.col("bads") / F.col("pages") / F.lit(share_bad)
    return staged(rows.join(names, same).select("token", "item", "pages", lift.alias("lift")), "url-items")


def least_sets(kinds: DataFrame, least: int) -> DataFrame:
    """Item sets that can be needed for a rule: ``items``, ``freq`` and ``bad_freq`` (pages that hold them, and bad ones).

    ``kinds`` holds distinct sorted arrays ``items`` with the number of their
    ``pages`` and ``bads``. Left out are sets in fewer than ``least`` bad pages,
    sets in the same pages as a part of them, and sets with a part that stands
    in bad pages alone: that part fits wherever they do, and no less surely.
    Every part of a set that stays has to stay and to be open, so a level is
    built from the one before it.
    """
    kinds = staged(kinds.withColumn("kind", F.monotonically_increasing_id()), "url-kinds")
    weights = kinds.select("kind", "pages", "bads")
    everywhere = weights.agg(F.sum("pages")).first()[0]
    held = kinds.select("kind", F.explode("items").alias("item")).select("kind", F.array("item").alias("items"))
    found, size = None, 1
    while True:
        counted = held.join(weights, "kind").groupBy("items").agg(F.sum("pages").alias("freq"), F.sum("bads").alias("bad_freq"))
        counted = counted.where(F.col("bad_freq") >= least)
        if size == 1:
            level = counted.where(F.col("freq") < everywhere)
        else:
            parts = counted.select("items", "freq", F.explode("items").alias("gone")).select(
                F.col("items").alias("whole"), F.col("freq").alias("whole_freq"), F.array_remove("items", F.col("gone")).alias("items")
            )
            fewer = parts.join(open_.select("items", "freq"), "items").where(F.col("whole_freq") < F.col("freq"))
            whole = fewer.groupBy(F.col("whole").alias("items")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
            level = counted.join(whole.select("items"), "items", "left_semi")
        level = staged(level, "url-level")
        found = level if found is None else found.unionByName(level)
        open_ = level.where(F.col("bad_freq") < F.col("freq"))
        if open_.isEmpty():
            return found
        # Two sets of a page that differ in their last item make a larger one.
        held = staged(held.join(open_.select("items"), "items", "left_semi"), "url-held")
        ends = held.select("kind", F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"))
        later = ends.select("kind", "head", F.col("last").alias("next"))
        held = ends.join(later, ["kind", "head"]).where(F.col("last") < F.col("next")).select(
            "kind", F.concat("head", F.array("last", "next")).alias("items")
        )
        size += 1


def mined_rules(
    tokens: DataFrame, labels: DataFrame, *, min_support: float, min_confidence: float, min_lift: float, least_pages: int = LEAST_PAGES
) -> tuple[DataFrame, DataFrame]:
    """Items (``token``, ``item``) and rules for "bad": ``rule``, ``needs`` (items), ``anchor`` (rarest item), ``confidence``.

    ``tokens`` holds ``key`` and ``tokens``, ``labels`` holds ``key`` and ``bad``.
    """
    spark = tokens.sparkSession
    joined = tokens.join(labels, "key").select(F.monotonically_increasing_id().alias("page"), "bad", "tokens")
    marked = staged(joined, "url-labelled")
    pages, bads = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(least_pages, math.ceil(min_support * pages))
    if bads < least:
        return (
            spark.createDataFrame([], "token string, item string"),
            spark.createDataFrame([], "rule long, needs array<string>, anchor string, confidence double"),
        )
    items = items_of(marked, least, bads / pages)
    named = marked.select("page", "bad", F.explode("tokens").alias("token")).join(small_side(items), "token")
    # An item of any number of tokens is one entry of a page.
    baskets = named.groupBy("page", "bad").agg(F.sort_array(F.collect_set("item")).alias("items"))
    baskets = staged(baskets, "url-baskets")
    total, widest = baskets.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    if not total:
        return items.select("token", "item"), spark.createDataFrame([], "rule long, needs array<string>, anchor string, confidence double")
    if widest <= WIDEST:
        marked_bad = F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items"))
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total)).fit(baskets.select(marked_bad.alias("items"))).freqItemsets
        sets = staged(sets.select(F.sort_array("items").alias("items"), "freq"), "url-itemsets")
        bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
        bad = bad.select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad_freq"))
        bad = bad.join(sets, "items")
    else:
        bad = least_sets(
            baskets.groupBy("items").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("bad").cast("long")).alias("bads")), least
        )
    confidence = F.col("bad_freq") / F.col("freq")
    rules = bad.select(F.xxhash64("items").alias("rule"), F.col("items").alias("needs"), confidence.alias("confidence"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bads / pages))
    counts = items.groupBy("item").agg(F.max("pages").alias("pages"))
    anchors = rules.select("rule", F.explode("needs").alias("item")).join(counts, "item").groupBy("rule").agg(
        F.min(F.struct("pages", "item")).alias("rarest")
    )
    rules = rules.join(anchors, "rule").select("rule", "needs", F.col("rarest.item").alias("anchor"), "confidence")
    return items.select("token", "item"), staged(rules, "url-rules")


def url_filter(
    pages: DataFrame, key: Column, url: Column, labels: DataFrame, *,
    min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.2, least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """Verdict of every page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (confidence).

    ``labels`` holds ``key`` and boolean ``bad``; null labels are left out.
    A fixed rule decides where one fits. Elsewhere a page is blocked if a mined
    rule fits, else allowed. Null and malformed URLs have empty host and path
    and are allowed. Without labels nothing is mined. Rows of equal key are
    judged one by one; labels of equal key count once each.
    """
    base = pages.select(key.alias("key"), url.alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    text, verdict = ruled(F.col("host"), F.col("path"))
    judged = base.select(
        "key", "host", "path", text.alias("rule"), verdict.alias("fixed"),
        url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    )
    clean = labels.where("bad is not null").select("key", "bad")
    items, rules = mined_rules(
        judged.select("key", "tokens"), clean, min_support=min_support, min_confidence=min_confidence, min_lift=min_lift, least_pages=least_pages
    )
    # pages of equal tokens are matched once; an item fits if any of its tokens is there
    kinds = judged.where("fixed is null").select("tokens").distinct()
    known = kinds.select("tokens", F.explode("tokens").alias("token")).join(small_side(items), "token")
    held = known.groupBy("tokens").agg(F.collect_set("item").alias("items"))
    hits = (
        held.select("tokens", "items", F.explode("items").alias("anchor"))
        .join(small_side(rules), "anchor")
        .where(F.size(F.array_except("needs", "items")) == 0)
        .groupBy("tokens").agg(F.max("confidence").alias("mined"))
    )
    return judged.join(hits, "tokens", "left").select(
        "key", "host", "path", "rule",
        F.coalesce("fixed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"),
    )


def query(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts for all pages; a page counts as bad if the labels of its number call it low or toxic."""
    bad = labels.select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter(pages, F.col("page_id"), F.col("url"), bad).withColumnRenamed("key", "page_id")
