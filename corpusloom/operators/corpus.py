"""Corpus filters, profiles, order statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import tags, text
from .quantiles import quantiles

#: Histogram ranges of the profiles (inclusive), those of the half-open profile, and percentiles.
LENGTH_RANGES = [(0, 10), (11, 20), (21, 40), (41, 60), (61, 100), (101, None)]
BEFORE_RANGES = [(0, 5), (6, 10), (11, 20), (21, 40), (41, 60), (61, 100), (101, None)]
HALF_OPEN = [(0, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, None)]
PERCENTILES_A, PERCENTILES_B = [50, 75, 80, 85, 90, 95, 99], [10, 25, 50, 75, 90]


def at_least_words(df: DataFrame, n: int = 20, column: str = "text") -> DataFrame:
    return df.where((F.coalesce(F.col(column), F.lit("")) != "") & (text.words(F.col(column)) >= n))


def more_than_words(df: DataFrame, n: int, column: str = "text") -> DataFrame:
    return df.where(text.words(F.col(column)) > n)


def balanced(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    return df.where(tags.is_balanced(F.col(column), tag))


def tagged(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    return df.where(F.contains(F.col(column), F.lit(tags.opening(tag))))


def long_original(df: DataFrame, least: int = 100, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    """Rows whose text without spans has `least` estimated tokens; the rows stay as they are."""
    return df.where(text.tokens_of_words(text.words(tags.strip(F.col(column), tag))) >= least)


def complete(df: DataFrame, columns: list[str], lists: list[str]) -> DataFrame:
    """Columns not empty, lists not empty and of one length."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.coalesce(F.col(c), F.lit("")) != ""
    for c in lists:
        ok &= (F.size(F.col(c)) > 0) & (F.size(F.col(c)) == F.size(F.col(lists[0])))
    return df.where(F.coalesce(ok, F.lit(False)))


def removal_counts(df: DataFrame, column: str = "text") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(text.chars(F.col(column)) < 10).alias("short_chars"), F.count_if(text.words(F.col(column)) < 3).alias("few_words"))


def filter_effect(df: DataFrame, kept: Column) -> DataFrame:
    n, k = F.count("*"), F.count_if(kept)
    return df.agg(n.alias("original"), k.alias("kept"), (n - k).alias("removed"), F.round(100 * k / n, 6).alias("kept_pct"), F.round(100 * (n - k) / n, 6).alias("removed_pct"))


def _counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Values with how many rows are before and up to each: order statistics without sorting single rows into one task.

    Rows are summed by value first; the running sum then only spans distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(w.orderBy("value"))
    return counted.withColumns({"upto": upto, "before": upto - F.col("n"), "total": F.sum("n").over(w)})


def length_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, min, max, mean and the upper median (the element at n div 2)."""
    by = by or []
    c = _counts(df, value, by)
    middle = F.floor(F.col("total") / 2)
    return c.groupBy(*by).agg(
        F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        F.max(F.when((F.col("before") <= middle) & (F.col("upto") > middle), F.col("value"))).alias("median"),
    )


def percentiles_by_index(df: DataFrame, value: str, points: list[int] | None = None, shifted: bool = True) -> DataFrame:
    """percentile, value, share: the element int(n*p/100) - 1 (shifted; left out below 0) or int(n*p/100) up to n - 1, and
    the share of rows up to that value."""
    c = _counts(df, value, [])
    p = F.explode(F.array(*map(F.lit, points or (PERCENTILES_A if shifted else PERCENTILES_B))))
    at = c.withColumn("percentile", p).withColumn("i", F.floor(F.col("total") * F.col("percentile") / 100))
    at = at.withColumn("i", F.col("i") - 1 if shifted else F.least("i", F.col("total") - 1))
    hit = at.where((F.col("i") >= 0) & (F.col("before") <= F.col("i")) & (F.col("upto") > F.col("i")))
    return hit.select("percentile", "value", F.round(100 * F.col("upto") / F.col("total"), 6).alias("share"))


def percentiles_linear(df: DataFrame, value: str) -> DataFrame:
    """mean, median, p95, p99 (linear between ranks) and max; without values all are null."""
    q = quantiles(df, value, [0.5, 0.95, 0.99]).select(*(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("median", "p95", "p99"))))
    ends = df.agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
    return ends.join(F.broadcast(q), F.lit(True), "left").select("mean", "median", "p95", "p99", "max")


def thresholds(df: DataFrame, value: str) -> DataFrame:
    """Distinct values of the shifted percentiles 20, 25, 30, 50, 75."""
    return percentiles_by_index(df, value, [20, 25, 30, 50, 75]).select(F.col("value").alias("threshold")).distinct()


def label_of(value: Column, ranges: list[tuple[int, int | None]], half_open: bool = False) -> Column:
    """The first range that holds a value; half open: its end excluded, so that some values have none."""
    out = F.lit(None).cast("string")
    for a, b in reversed(ranges):
        name = f"{a}-{b}" if b is not None else f"{a}+"
        held = (value >= a) & ((value < b if half_open else value <= b) if b is not None else F.lit(True))
        out = F.when(held, name).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, ranges: list[tuple[int, int | None]], half_open: bool = False) -> DataFrame:
    """bucket, n, pct of all rows; empty buckets show 0."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, f"{a}-{b}" if b is not None else f"{a}+") for i, (a, b) in enumerate(ranges)], "pos int, bucket string")
    counted = df.groupBy(label_of(F.col(value), ranges, half_open).alias("b")).agg(F.count("*").alias("k"))
    total = counted.agg(F.sum("k").alias("total"))  # of the same exchange: the rows are read once
    return F.broadcast(names).join(counted, F.col("bucket") == F.col("b"), "left").crossJoin(F.broadcast(total)).select("bucket", F.coalesce("k", F.lit(0)).alias("n"), F.round(100 * F.coalesce("k", F.lit(0)) / F.col("total"), 6).alias("pct"))


def dynamic_ranges(most: int) -> list[tuple[int, int | None]]:
    """Token ranges that follow the largest value."""
    fine = [(0, 30), (31, 60), (61, 100), (101, 200), (201, 500), (501, 1000)]
    for limit in (1000, 2000, 4000):
        if most <= limit:
            return [*fine, *((a + 1, a + 500) for a in range(1000, limit, 500)), (limit, None)]
    return [*fine, *((a + 1, min(a + 500, most)) for a in range(1000, most, 500)), (most + 1, None)]


def dynamic_histogram(df: DataFrame, value: str) -> DataFrame:
    most = df.agg(F.max(value)).first()[0] or 0  # one number decides the ranges
    return histogram(df, value, dynamic_ranges(int(most)))


def tag_profile(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    """Totals of a tagged corpus in one pass: tags, pairs per item, items with and without, words before the first tag, token ratio."""
    c = F.col(column)
    facts = df.select(tags.opens(c, tag).alias("o"), tags.closes(c, tag).alias("c"), tags.words_before(c, tag).alias("before"), text.words(c).alias("w"), text.words(tags.strip(c, tag)).alias("bare"))
    has = F.col("o") > 0
    est = lambda x: text.tokens_of_words(F.col(x))
    return facts.agg(
        F.count("*").alias("items"), F.sum("o").alias("open_tags"), F.sum("c").alias("close_tags"), F.sum(F.least("o", "c")).alias("pairs"),
        F.round(F.sum(F.least("o", "c")) / F.count("*"), 6).alias("pairs_per_item"), F.count_if(has).alias("with_tags"), F.count_if(~has).alias("without_tags"),
        F.round(F.avg(F.when(has, F.col("before"))), 6).alias("mean_before"), F.round(F.sum("before") / F.sum("w"), 6).alias("before_ratio"),
        F.round(F.avg(est("w")), 6).alias("mean_tokens"), F.round(F.avg(est("bare")), 6).alias("mean_original_tokens"), F.round(F.avg(est("bare")) / F.avg(est("w")), 6).alias("original_ratio"),
        F.max(est("w")).alias("max_tokens"),
    )


def cleaned_profile(df: DataFrame, column: str = "completion", threshold: int = 10, least: int = 100, tag: str = tags.TAG) -> DataFrame:
    """Profile of what early removal, the balance, tag and length filters leave. One pass: the cleaned text is bound
    once a row in a lambda, and the filters are conditions of the sums, so that nothing is worked out twice."""
    c = lambda t: F.struct(
        tags.opens(t, tag).alias("o"), tags.closes(t, tag).alias("k"), tags.words_before(t, tag).alias("before"),
        text.tokens_of_words(text.words(t)).alias("tokens"), text.tokens_of_words(text.words(tags.strip(t, tag))).alias("original"),
    )
    facts = df.select(F.inline(F.transform(F.array(tags.remove_early(F.col(column), threshold, tag)), lambda e: c(e["text"]))))
    kept = facts.where((F.col("o") == F.col("k")) & (F.col("o") > 0) & (F.col("original") >= least))
    return kept.agg(F.count("*").alias("items"), F.sum("o").alias("tags"), F.round(F.avg("before"), 6).alias("mean_before"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.avg("original"), 6).alias("mean_original_tokens"))


def training_advice(profile: DataFrame, batch: int = 1) -> DataFrame:
    m = F.col("max_tokens")
    return profile.select("max_tokens", F.when(m > 4000, "very_long").when(m > 2000, "long").otherwise("regular").alias("tier"), (m * 2 * batch).alias("memory_hint"))


def tag_distribution(df: DataFrame, least: int = 100, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    return long_original(df, least, column, tag).groupBy(tags.opens(F.col(column), tag).alias("n_open")).agg(F.count("*").alias("n"))


def problems(df: DataFrame, order: str, n: int = 10, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    """The first n unbalanced rows in the order of the file, with what is wrong."""
    bad = df.where(~tags.is_balanced(F.col(column), tag))
    return bad.select(order, tags.issues(F.col(column), tag).alias("issues")).orderBy(order).limit(n)


def balance_summary(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count("*").alias("total"), F.count_if(tags.is_balanced(c, tag)).alias("balanced"), F.count_if(~tags.is_balanced(c, tag)).alias("unbalanced"), F.count_if(tags.unclosed_at_end(c, tag) & ~tags.is_balanced(c, tag)).alias("unclosed_at_end"))


def issue_counts(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    return df.select(F.explode(tags.issues(F.col(column), tag)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")


def pattern_counts(df: DataFrame, column: str = "completion", tag: str = tags.TAG) -> DataFrame:
    return df.select(F.explode(tags.patterns(F.col(column), tag)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def reasoning_totals(df: DataFrame, by: str, gold: str = "gold_label", tows: str = "tows") -> DataFrame:
    """Per file and in all: items, words, reasonings, [ERROR] marks, error and completion rates."""
    errors = F.aggregate(F.transform(tows, lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"\[ERROR\]"))), F.lit(0), lambda a, x: a + x)
    facts = df.select(by, F.size(gold).alias("g"), F.size(tows).alias("t"), errors.alias("e"))
    done = F.sum("t") - F.sum("e")
    return facts.rollup(by).agg(F.count("*").alias("items"), F.sum("g").alias("words"), F.sum("t").alias("reasonings"), F.sum("e").alias("errors"), F.round(100 * F.sum("e") / F.sum("t"), 6).alias("error_rate"), F.round(100 * done / F.sum("g"), 6).alias("completion_rate"))


def first_of_each(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """split: the first n of a group are dev, the others test; groups of under n are dev whole."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("split", F.when(r <= n, "dev").otherwise("test"))


def cumulative(df: DataFrame, value: str) -> DataFrame:
    return _counts(df, value, []).select("value", F.round(100 * F.col("upto") / F.col("total"), 6).alias("cum_pct"))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit position."""
    return df.orderBy(order).limit(n)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first n rows in a seeded order: the same ones whenever it is worked out again."""
    return df.orderBy(text.shuffled(F.col(key), seed), key).limit(n)


def all_rows(*frames: DataFrame) -> DataFrame:
    """The rows of frames of one layout."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cast_union(schema: str, *frames: DataFrame) -> DataFrame:
    """The rows of frames whose columns are cast to one schema first; a column that one lacks raises an error."""
    fields = StructType.fromDDL(schema).fields
    return all_rows(*(f.select(*(f[x.name].cast(x.dataType).alias(x.name) for x in fields)) for f in frames))
