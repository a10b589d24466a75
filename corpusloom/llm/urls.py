"""URL filtering by association rules: FP-growth over URL tokens and labels, matched by an inverted index. No Python on rows."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"
SUPPORT, CONFIDENCE = 0.002, 0.6
#: Blocked rows that a rule needs however few rows are labelled: one or two say nothing of others.
LEAST_ROWS = 5


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path (digits as one class), keys of the query."""
    pick = lambda text, cut: F.filter(F.split(text, cut), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    host = F.transform(pick(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    path = F.transform(pick(path_of(url), "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(pick(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(host, path, keys))


def mine_classes(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled (url, block boolean) -> rules (items, confidence, support) that speak for blocking, classes (token, item).

    Tokens that stand in exactly the same rows are one item, named by the smallest of them, so that a long url of which there
    are many copies counts as one item, not as all sets of its tokens. Tokens that the label makes too rare for any
    rule are left out first. FP-growth over items and the label; rules need `confidence`, `support` and LEAST_ROWS rows; a rule that
    contains another one's items without being more certain adds nothing and is dropped. No rows or no rule: empty tables.
    """
    told = labelled.where("url is not null and block is not null").select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("own"), "block")
    told = written(told.where(F.col("block") | (F.size("own") > 0)), "labelled")
    least = max(LEAST_ROWS, math.ceil(support * told.count()))
    lists = told.select("row", "block", F.explode("own").alias("token"))
    same_rows = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    often = lists.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("bad"), *same_rows).where(F.col("bad") >= least)
    # at most (tokens of a url) / support tokens are left
    classes = written(often.withColumn("item", F.min("token").over(Window.partitionBy("n", "h1", "h2"))).select("token", "item"), "classes")
    items = lists.join(classes.where("token = item").select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.max("block").alias("block"))
    baskets = items.select(F.concat("items", F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = written(baskets, "baskets")
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, baskets.count())), minConfidence=confidence).fit(baskets).associationRules
    rules = found.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    rules = written(rules, "rules")
    wider, narrower = rules.alias("a"), rules.select(F.explode("items").alias("one"), F.col("items").alias("less"), F.col("confidence").alias("sure"))
    # a narrower rule shares its first item with the wider one
    first = narrower.where(F.col("one") == F.element_at("less", 1))
    met = wider.withColumn("one", F.explode("items")).join(first, "one").where((F.size("less") < F.size("items")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0))
    return rules.join(met.select("items").distinct(), "items", "left_anti"), classes


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """The rules of mine_classes with every choice of tokens for their items: (tokens, confidence, support)."""
    rules, classes = mine_classes(labelled, support, confidence)
    same = classes.groupBy("item").agg(F.collect_list("token").alias("same"))
    parts = rules.select("items", "confidence", "support", F.explode("items").alias("item")).join(same, "item").groupBy("items", "confidence", "support").agg(F.collect_list("same").alias("parts"))
    one_more = lambda made, part: F.flatten(F.transform(made, lambda m: F.transform(part, lambda t: F.array_append(m, t))))
    sets = F.aggregate("parts", F.array(F.array().cast("array<string>")), one_more)
    return parts.select(F.explode(sets).alias("tokens"), "confidence", "support").select(F.array_sort("tokens").alias("tokens"), "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """urls (url, distinct) -> url, confidence of the surest rule of whose items the url all has.

    A url has an item if it has one of its tokens. Inverted index: each rule stands under its rarest item,
    each url looks up its own items and verifies the rest.
    """
    used = classes.join(rules.select(F.explode("items").alias("item")).distinct(), "item", "left_semi")
    held = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(used, "token").groupBy("url").agg(F.collect_set("item").alias("own"))
    lists = held.select("url", "own", F.explode("own").alias("item"))
    often = lists.groupBy("item").agg(F.count("*").alias("n"))
    keyed = rules.select("items", "confidence", F.explode("items").alias("item")).join(often, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.max("confidence").alias("confidence"))
    hits = lists.join(keyed, "item").where(F.size(F.array_except("items", "own")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence: one row for each page.

    rules: (verdict, host, path) by hand; one fits its host and all subdomains where the path starts with its
    own, the longest (host and path) wins. Without one, a url is blocked if a mined rule matches, else allowed. Null urls
    and such without :// have empty hosts and paths and are allowed; null and repeated ids are kept; no pages, no rows.
    """
    own = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = own.select("page_id", "url", host.alias("host"), path.alias("path"))
    hand = F.array(*(F.struct((-F.length(F.lit(h + p))).alias("order"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules)) if rules else None
    if hand is not None:
        fits = F.filter(hand, lambda r: ((F.col("host") == r["h"]) | F.col("host").endswith(F.concat(F.lit("."), r["h"]))) & F.col("path").startswith(r["p"]))
        own = own.withColumn("__best", F.try_element_at(F.array_sort(fits), F.lit(1)))
        own = own.select("page_id", "url", "host", "path", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("__hand"))
    else:
        own = own.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("__hand"))
    found = matched(own.where("url is not null").select("url").distinct(), *mine_classes(labelled)).withColumnRenamed("url", "__url")
    out = own.join(found, own.url == found["__url"], "left")
    verdict = F.coalesce("__hand", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
