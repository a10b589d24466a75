"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, splice, tags, text, vectors
from ..operators import attention, bloom, confidence, corpus, factors, klue, mixing, neighbours, panels, representation, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs that the tables lack, derived alike on both sides


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("words", text.words(F.col("text")).cast("long"))


def tagged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a span before every so many words; some are unbalanced."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    every = 5 + F.col("doc_id") % 23
    marked = F.transform(text.word_list(F.col("text")), lambda w, i: F.when((i + 1) % every == 0, F.concat(F.lit("<ToW>since "), w, F.lit(" follows</ToW> "), w)).otherwise(w))
    line = F.array_join(marked, " ")
    m = F.col("doc_id") % 17
    return d.select("doc_id", F.when(m == 0, F.concat(line, F.lit(" <ToW>"))).when(m == 1, F.concat(F.lit("</ToW> "), line)).when(m == 2, F.concat(line, F.lit(" <ToW> <ToW> end"))).otherwise(line).alias("completion"))


W = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
DOCS = f"d AS (SELECT doc_id, text, lang, source, {W.format('text')} AS words FROM documents)"
CORPUS = """c0 AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), lambda w, i:
  CASE WHEN i % (5 + doc_id % 23) = 0 THEN '<ToW>since ' || w || ' follows</ToW> ' || w ELSE w END), ' ') AS line FROM documents),
c AS (SELECT doc_id, CASE doc_id % 17 WHEN 0 THEN line || ' <ToW>' WHEN 1 THEN '</ToW> ' || line WHEN 2 THEN line || ' <ToW> <ToW> end' ELSE line END AS completion FROM c0),
t AS (SELECT doc_id, completion, len(regexp_extract_all(completion, '<ToW>')) AS o, len(regexp_extract_all(completion, '</ToW>')) AS k,
  regexp_replace(completion, '<ToW>.*?</ToW>', '', 'gs') AS bare, len(regexp_extract_all(completion, '(?s)<ToW>.*?</ToW>')) AS blocks FROM c)"""

_BEFORE = W.format("split_part(completion, '<ToW>', 1)")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of models to items, derived from orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("u"))
    letter = lambda c: F.char(c + 65)
    raw = F.when(F.col("k") % 11 == 0, "ERROR none").otherwise(F.concat(F.lit("first {"), letter(F.col("u") % 4), F.lit("} then {"), letter((F.col("k") * 7 + F.col("u")) % 5), F.lit("}")))
    m = F.col("u") % 7
    a = o.select("k", "u", F.concat(F.lit("m"), m.cast("string"), F.when(m < 3, "-ToW").otherwise("")).alias("model"), F.concat(F.lit("s"), (F.col("k") % 13).cast("string")).alias("subject"), letter(F.col("k") % 4).alias("ground_truth"), raw.alias("model_raw_output"))
    a = a.withColumn("predicted_answer", extract.boxed(F.col("model_raw_output"), last=True)).withColumn("first_answer", extract.boxed(F.col("model_raw_output")))
    return a.withColumns({"is_correct": F.coalesce(F.col("predicted_answer") == F.col("ground_truth"), F.lit(False)), "first_correct": F.coalesce(F.col("first_answer") == F.col("ground_truth"), F.lit(False))})


ANSWERS = """a0 AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS u FROM orders),
a1 AS (SELECT k, u, 'm' || (u % 7) || CASE WHEN u % 7 < 3 THEN '-ToW' ELSE '' END AS model, 's' || (k % 13) AS subject, chr(CAST(65 + k % 4 AS INTEGER)) AS ground_truth,
  CASE WHEN k % 11 = 0 THEN 'ERROR none' ELSE 'first {' || chr(CAST(65 + u % 4 AS INTEGER)) || '} then {' || chr(CAST(65 + (k * 7 + u) % 5 AS INTEGER)) || '}' END AS model_raw_output FROM a0),
a2 AS (SELECT *, list_extract(regexp_extract_all(upper(model_raw_output), '\\{([A-D])\\}', 1), -1) AS predicted_answer, list_extract(regexp_extract_all(upper(model_raw_output), '\\{([A-D])\\}', 1), 1) AS first_answer FROM a1),
a AS (SELECT *, coalesce(predicted_answer = ground_truth, false) AS is_correct, coalesce(first_answer = ground_truth, false) AS first_correct FROM a2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, subject, accuracy (strict, as a fraction)."""
    return scoring.accuracies(answers(spark, sf_dir), ["model", "subject"]).select("model", "subject", F.round(F.col("accuracy_strict") / 100, 6).alias("metric"))


SCORES = ANSWERS + """,
s AS (SELECT model, subject, round(round(100.0 * count(*) FILTER (is_correct) / count(*), 6) / 100, 6) AS metric FROM a GROUP BY model, subject)"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, lang, v, and a second model's vectors (components swapped in part)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", vectors.doubles(F.col("embedding")).alias("v"))
    other = F.transform("v", lambda x, i: F.when(i % 3 == 0, x * 0.5).otherwise(x))
    return e.withColumns({"lang": F.when(F.col("idx") % 2 == 0, "en").otherwise("ko"), "base": F.col("v"), "train": other})


EMB = """e AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN x * 0.5 ELSE x END) AS train,
  CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'ko' END AS lang FROM embeddings)"""


def token_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir)
    return e.select((F.col("idx") / 10).cast("long").alias("text_id"), (F.col("idx") % 10).alias("pos"), "lang", vectors.softmax(F.transform("v", lambda x: x * 8)).alias("probs"))


PROBS = EMB + """,
p AS (SELECT idx // 10 AS text_id, idx % 10 AS pos, lang, list_transform(x, lambda y: y / list_sum(x)) AS probs FROM (SELECT *, list_transform(v, lambda y: exp(y * 8)) AS x FROM e))"""


def attention_blocks(spark: SparkSession, sf_dir: str, shift: float = 0.0, heads: int = 3) -> DataFrame:
    """Row-normalised weights from the vectors: 64 of them one after another are the rows of a layer; the heads take their components forwards and backwards by turns, each by half of the one before."""
    e = embedded(spark, sf_dir)
    w = lambda x, h: vectors.softmax(F.transform(x, lambda y: y * ((4 + shift) * 0.5**h)))
    each = [F.struct(F.lit(h).cast("long").alias("head"), w(F.reverse("v") if h % 2 else F.col("v"), h).alias("w")) for h in range(heads)]
    return e.select(F.concat(F.lit("layer"), F.floor(F.col("idx") / 64).cast("string")).alias("layer"), (F.col("idx") % 64).alias("i"), F.array(*each).alias("heads"))


def _att(name: str, scale: str, heads: int = 3) -> str:
    own = ", ".join(f"list_transform({'list_reverse(v)' if h % 2 else 'v'}, lambda y: y * {0.5**h})" for h in range(heads))
    return f"""{name}x AS (SELECT 'layer' || idx // 64 AS layer, idx % 64 AS i, unnest(range({heads})) AS head, unnest([{own}]) AS v FROM e),
{name}y AS (SELECT layer, head, i, list_transform(v, lambda y: exp(y * {scale})) AS x FROM {name}x),
{name} AS (SELECT layer, head, i, unnest(range(len(x))) AS j, unnest(list_transform(x, lambda y: y / list_sum(x))) AS w FROM {name}y)"""


ATT = EMB + ",\n" + _att("att", "4")

# ---- lengths


@query(f"WITH {DOCS}, o AS (SELECT words, row_number() OVER (ORDER BY words) AS r, count(*) OVER () AS n FROM d) SELECT count(*) AS \"count\", min(words) AS min, max(words) AS max, round(sum(words) / count(*), 6) AS mean, max(CASE WHEN r = n // 2 + 1 THEN words END) AS median FROM o")
def doc_length_profile(spark, sf_dir):
    return corpus.length_summary(documents(spark, sf_dir), "words")


@query(f"WITH {DOCS}, o AS (SELECT source, words, row_number() OVER (PARTITION BY source ORDER BY words) AS r, count(*) OVER (PARTITION BY source) AS n FROM d) SELECT source, count(*) AS \"count\", min(words) AS min, max(words) AS max, round(sum(words) / count(*), 6) AS mean, max(CASE WHEN r = n // 2 + 1 THEN words END) AS median FROM o GROUP BY source")
def source_length_stats(spark, sf_dir):
    return corpus.length_summary(documents(spark, sf_dir), "words", ["source"])


_PCT = f"WITH {DOCS}, o AS (SELECT words, row_number() OVER (ORDER BY words) AS r, count(*) OVER () AS n FROM d), q AS (SELECT unnest([%s]) AS percentile) SELECT q.percentile, o.words AS value, round(100.0 * (SELECT count(*) FROM d WHERE d.words <= o.words) / o.n, 6) AS share FROM q JOIN o ON o.r = %s"


@query(_PCT % ("50,75,80,85,90,95,99", "o.n * q.percentile // 100"))
def length_percentiles_shifted(spark, sf_dir):
    return corpus.percentiles_by_index(documents(spark, sf_dir), "words")


@query(_PCT % ("10,25,50,75,90", "least(o.n * q.percentile // 100, o.n - 1) + 1"))
def length_percentiles_index(spark, sf_dir):
    return corpus.percentiles_by_index(documents(spark, sf_dir), "words", shifted=False)


@query(f"WITH {DOCS} SELECT round(avg(words), 6) AS mean, round(quantile_cont(words, 0.5), 6) AS median, round(quantile_cont(words, 0.95), 6) AS p95, round(quantile_cont(words, 0.99), 6) AS p99, max(words) AS max FROM d")
def length_percentiles_linear(spark, sf_dir):
    return corpus.percentiles_linear(documents(spark, sf_dir), "words")


@query(f"SELECT DISTINCT value AS threshold FROM ({_PCT % ('20,25,30,50,75', 'o.n * q.percentile // 100')})")
def length_thresholds(spark, sf_dir):
    return corpus.thresholds(documents(spark, sf_dir), "words")


def _buckets(ranges, half_open=False, value="words", source="d") -> str:
    rows = ", ".join(f"('{a}-{b}' , {a}, {b})" if b is not None else f"('{a}+', {a}, NULL)" for a, b in ranges)
    end = f"({source}.{value} < b.b OR b.b IS NULL)" if half_open else f"({source}.{value} <= b.b OR b.b IS NULL)"
    return f"SELECT b.bucket, count({source}.{value}) AS n, round(100.0 * count({source}.{value}) / (SELECT count(*) FROM {source}), 6) AS pct FROM (VALUES {rows}) AS b(bucket, a, b) LEFT JOIN {source} ON {source}.{value} >= b.a AND {end} GROUP BY b.bucket"


@query(f"WITH {DOCS} " + _buckets(corpus.LENGTH_RANGES))
def length_buckets(spark, sf_dir):
    return corpus.histogram(documents(spark, sf_dir), "words", corpus.LENGTH_RANGES)


@query(f"WITH {DOCS} " + _buckets(corpus.HALF_OPEN, True))
def length_buckets_half_open(spark, sf_dir):
    return corpus.histogram(documents(spark, sf_dir), "words", corpus.HALF_OPEN, half_open=True)


@query(f"WITH {DOCS} SELECT count(*) AS original, count(*) FILTER (words > 100) AS kept, count(*) FILTER (words <= 100) AS removed, round(100.0 * count(*) FILTER (words > 100) / count(*), 6) AS kept_pct, round(100.0 * count(*) FILTER (words <= 100) / count(*), 6) AS removed_pct FROM d")
def filter_effect(spark, sf_dir):
    return corpus.filter_effect(documents(spark, sf_dir), F.col("words") > 100)


@query(f"WITH {DOCS} SELECT doc_id FROM d WHERE text <> '' AND words >= 20")
def length_filter(spark, sf_dir):
    return corpus.at_least_words(documents(spark, sf_dir)).select("doc_id")


@query(f"WITH {DOCS} SELECT count(*) AS total, count(*) FILTER (length(text) < 10) AS short_chars, count(*) FILTER (words < 3) AS few_words FROM d")
def removal_counts(spark, sf_dir):
    return corpus.removal_counts(documents(spark, sf_dir))


@query(f"WITH {DOCS}, n AS (SELECT words, count(*) AS n FROM d GROUP BY words) SELECT words AS value, round(100.0 * sum(n) OVER (ORDER BY words) / sum(n) OVER (), 6) AS cum_pct FROM n")
def cumulative_lengths(spark, sf_dir):
    return corpus.cumulative(documents(spark, sf_dir), "words")


@query(f"WITH {DOCS} SELECT doc_id, length(text) AS chars, words * 133 // 100 AS tokens, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, round(words / 1000000.0 * 0.3 + words / 1000000.0 * 2.5, 9) AS usd FROM d")
def text_measures(spark, sf_dir):
    t, n = F.col("text"), F.col("words")
    return documents(spark, sf_dir).select("doc_id", text.chars(t).cast("long").alias("chars"), text.tokens_of_words(n).alias("tokens"), text.preview(t).alias("preview"), text.squeeze(t).alias("squeezed"), F.round(text.cost(n, n), 9).alias("usd"))


# ---- tags


@query(f"WITH {CORPUS} SELECT doc_id, o AS opens, k AS closes, blocks FROM t")
def tag_counts(spark, sf_dir):
    c = F.col("completion")
    return tagged_corpus(spark, sf_dir).select("doc_id", tags.opens(c).cast("long").alias("opens"), tags.closes(c).cast("long").alias("closes"), tags.blocks(c).cast("long").alias("blocks"))


@query(f"WITH {CORPUS} SELECT doc_id, bare FROM t")
def tag_strip(spark, sf_dir):
    return tagged_corpus(spark, sf_dir).select("doc_id", tags.strip(F.col("completion")).alias("bare"))


@query(f"WITH {CORPUS} SELECT doc_id, {_BEFORE} AS before FROM t")
def words_before_tag(spark, sf_dir):
    return tagged_corpus(spark, sf_dir).select("doc_id", tags.words_before(F.col("completion")).cast("long").alias("before"))


@query(f"WITH {CORPUS}, b0 AS (SELECT {_BEFORE} AS before FROM t WHERE o > 0) " + _buckets(corpus.BEFORE_RANGES, value="before", source="b0"))
def before_tag_buckets(spark, sf_dir):
    c = corpus.tagged(tagged_corpus(spark, sf_dir)).select(tags.words_before(F.col("completion")).alias("before"))
    return corpus.histogram(c, "before", corpus.BEFORE_RANGES)


_STEP = """CASE WHEN strpos(x, '<ToW>') = 0 OR """ + W.format("x[1:strpos(x, '<ToW>') - 1]") + """ > 10 THEN x
  WHEN strpos(x[strpos(x, '<ToW>') + 5:], '</ToW>') = 0 THEN x[1:strpos(x, '<ToW>') - 1] || x[strpos(x, '<ToW>') + 5:]
  ELSE x[1:strpos(x, '<ToW>') - 1] || x[strpos(x, '<ToW>') + 5:][strpos(x[strpos(x, '<ToW>') + 5:], '</ToW>') + 6:] END"""


@query(f"""WITH RECURSIVE {CORPUS}, r(doc_id, x, n) AS (SELECT doc_id, completion, 0 FROM c UNION ALL SELECT doc_id, y, n + 1 FROM (SELECT doc_id, x, n, {_STEP} AS y FROM r) WHERE y <> x),
l AS (SELECT doc_id, max(n) AS n, arg_max(x, n) AS x FROM r GROUP BY doc_id) SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS completion, n AS removed FROM l""")
def early_tag_removal(spark, sf_dir):
    e = tags.remove_early(F.col("completion"))
    return tagged_corpus(spark, sf_dir).select("doc_id", e.alias("e")).select("doc_id", F.col("e.text").alias("completion"), F.col("e.removed").alias("removed"))


@query(f"WITH {CORPUS} SELECT doc_id FROM t WHERE o = k")
def balance_filter(spark, sf_dir):
    return corpus.balanced(tagged_corpus(spark, sf_dir)).select("doc_id")


@query(f"WITH {CORPUS} SELECT doc_id FROM t WHERE o > 0")
def tagged_only(spark, sf_dir):
    return corpus.tagged(tagged_corpus(spark, sf_dir)).select("doc_id")


@query(f"WITH {CORPUS} SELECT doc_id, completion FROM t WHERE {W.format('bare')} * 133 // 100 >= 100")
def long_original(spark, sf_dir):
    return corpus.long_original(tagged_corpus(spark, sf_dir))


_ISSUES = """list_filter([CASE WHEN o > k THEN 'Missing ' || (o - k) || ' closing tags' END, CASE WHEN k > o THEN 'Missing ' || (k - o) || ' opening tags' END,
  CASE WHEN blocks <> least(o, k) THEN 'Found ' || o || ' opening tags, ' || k || ' closing tags, but only ' || blocks || ' complete blocks' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {CORPUS}, i AS (SELECT unnest({_ISSUES}) AS issue FROM t) SELECT issue, count(*) AS n FROM i GROUP BY issue")
def balance_issues(spark, sf_dir):
    return corpus.issue_counts(tagged_corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (o = k) AS balanced, count(*) FILTER (o <> k) AS unbalanced, count(*) FILTER (o <> k AND (regexp_matches(completion, '<ToW>\\s*$') OR contains(list_extract(string_split(completion, '</ToW>'), -1), '<ToW>'))) AS unclosed_at_end FROM t")
def balance_summary(spark, sf_dir):
    return corpus.balance_summary(tagged_corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, p AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(completion, '<ToW>\\s*$') THEN 'ENDS_WITH_OPEN_TOW' END, CASE WHEN list_extract(regexp_extract_all(completion, '</?ToW>'), -1) = '<ToW>' THEN 'LAST_TOW_UNCLOSED' END,
  CASE WHEN longest > 1 THEN 'CONSECUTIVE_OPENS_' || longest END], lambda x: x IS NOT NULL)) AS pattern FROM (SELECT *, list_max(list_transform(regexp_extract_all(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(completion, '</?ToW>'), ''), '</ToW>', '|', 'g'), '<ToW>', 'o', 'g'), 'o*'), lambda r: length(r))) AS longest FROM t) WHERE o > k) SELECT pattern, count(*) AS n FROM p GROUP BY pattern""")
def imbalance_patterns(spark, sf_dir):
    return corpus.pattern_counts(tagged_corpus(spark, sf_dir))


@query(f"""WITH {CORPUS} SELECT doc_id, list_transform(regexp_extract_all(completion, '</?ToW>'), lambda x: CASE x WHEN '<ToW>' THEN 'open' ELSE 'close' END) AS kinds, strpos(completion, '<ToW>') - 1 AS first_start FROM t WHERE o > 0""")
def tag_positions(spark, sf_dir):
    p = corpus.tagged(tagged_corpus(spark, sf_dir)).withColumn("p", tags.positions(F.col("completion")))
    first = F.array_min(F.transform(F.filter("p", lambda x: x["kind"] == "open"), lambda x: x["start"]))
    return p.select("doc_id", F.transform("p", lambda x: x["kind"]).alias("kinds"), first.cast("long").alias("first_start"))


_WC = W.format("completion")
_WB = W.format("bare")


@query(f"""WITH {CORPUS}, f AS (SELECT o, k, {_BEFORE} AS b, {_WC} AS w, {_WC} * 133 // 100 AS tw, {_WB} * 133 // 100 AS tb FROM t)
SELECT count(*) AS items, sum(o) AS open_tags, sum(k) AS close_tags, sum(least(o, k)) AS pairs, round(sum(least(o, k)) / count(*), 6) AS pairs_per_item, count(*) FILTER (o > 0) AS with_tags, count(*) FILTER (o = 0) AS without_tags,
round(avg(b) FILTER (o > 0), 6) AS mean_before, round(sum(b) / sum(w), 6) AS before_ratio, round(avg(tw), 6) AS mean_tokens, round(avg(tb), 6) AS mean_original_tokens, round(avg(tb) / avg(tw), 6) AS original_ratio, max(tw) AS max_tokens FROM f""")
def corpus_profile(spark, sf_dir):
    return corpus.tag_profile(tagged_corpus(spark, sf_dir))


@query(f"WITH {CORPUS}, m AS (SELECT max({_WC} * 133 // 100) AS max_tokens FROM t) SELECT max_tokens, CASE WHEN max_tokens > 4000 THEN 'very_long' WHEN max_tokens > 2000 THEN 'long' ELSE 'regular' END AS tier, max_tokens * 2 * 4 AS memory_hint FROM m")
def training_advice(spark, sf_dir):
    return corpus.training_advice(corpus.tag_profile(tagged_corpus(spark, sf_dir)), 4)


@query(f"WITH {CORPUS} SELECT o AS n_open, count(*) AS n FROM t WHERE {_WB} * 133 // 100 >= 100 GROUP BY o")
def tag_distribution_100plus(spark, sf_dir):
    return corpus.tag_distribution(tagged_corpus(spark, sf_dir)).withColumn("n_open", F.col("n_open").cast("long"))


@query(f"""WITH {CORPUS}, v AS (SELECT {_WC} * 133 // 100 AS v FROM t), m AS (SELECT max(v) AS m FROM v),
a AS (SELECT [(0, 30), (31, 60), (61, 100), (101, 200), (201, 500), (501, 1000)] AS fine, m, CASE WHEN m <= 1000 THEN 1000 WHEN m <= 2000 THEN 2000 WHEN m <= 4000 THEN 4000 ELSE m END AS top FROM m),
b AS (SELECT unnest(range(1000, top, 500)) AS s, top FROM a),
r AS (SELECT unnest([0, 31, 61, 101, 201, 501]) AS lo, unnest([30, 60, 100, 200, 500, 1000]) AS hi UNION ALL SELECT s + 1, least(s + 500, top) FROM b UNION ALL SELECT CASE WHEN m > 4000 THEN m + 1 ELSE top END, NULL FROM a),
h AS (SELECT v, (SELECT min(lo) FROM r WHERE v >= lo AND (hi IS NULL OR v <= hi)) AS lo FROM v)
SELECT CASE WHEN hi IS NULL THEN r.lo || '+' ELSE r.lo || '-' || r.hi END AS bucket, count(h.v) AS n, round(100.0 * count(h.v) / (SELECT count(*) FROM v), 6) AS pct FROM r LEFT JOIN h ON h.lo = r.lo GROUP BY ALL""")
def dynamic_token_buckets(spark, sf_dir):
    c = tagged_corpus(spark, sf_dir).select(text.tokens_of_words(text.words(F.col("completion"))).alias("v"))
    return corpus.dynamic_histogram(c, "v")


@query(f"""WITH RECURSIVE {CORPUS}, r(doc_id, x, n) AS (SELECT doc_id, completion, 0 FROM c UNION ALL SELECT doc_id, y, n + 1 FROM (SELECT doc_id, x, n, {_STEP} AS y FROM r) WHERE y <> x),
l AS (SELECT doc_id, trim(regexp_replace(arg_max(x, n), '\\s+', ' ', 'g')) AS x FROM r GROUP BY doc_id),
f AS (SELECT len(regexp_extract_all(x, '<ToW>')) AS o, len(regexp_extract_all(x, '</ToW>')) AS k, {W.format("split_part(x, '<ToW>', 1)")} AS b, {W.format("x")} AS w, {W.format("regexp_replace(x, '<ToW>.*?</ToW>', '', 'gs')")} AS wb FROM l)
SELECT count(*) AS items, sum(o) AS tags, round(avg(b), 6) AS mean_before, round(avg(w * 133 // 100), 6) AS mean_tokens, round(avg(wb * 133 // 100), 6) AS mean_original_tokens FROM f WHERE o = k AND o > 0 AND wb * 133 // 100 >= 100""")
def cleaned_corpus_profile(spark, sf_dir):
    """The flagship: early spans removed, balanced and tagged rows of at least 100 original tokens, profiled in one pass."""
    return corpus.cleaned_profile(tagged_corpus(spark, sf_dir))


# ---- splicing


def _gold(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).where("words >= 12")
    w = text.word_list(F.col("text"))
    gold = F.array(F.get(w, F.lit(3)), F.get(w, F.lit(7)), F.get(w, F.lit(10)))
    return d.select("doc_id", F.array_join(w, " ").alias("sentence"), gold.alias("gold_label")).withColumn("tows", F.transform("gold_label", lambda x, i: F.concat(F.lit("<ToW>"), F.when((F.col("doc_id") + i) % 9 == 0, "[ERROR]").otherwise("r"), i.cast("string"), F.lit("</ToW>"))))


_GOLD = f"""{DOCS}, g0 AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM d WHERE words >= 12),
g AS (SELECT doc_id, array_to_string(w, ' ') AS sentence, [w[4], w[8], w[11]] AS gold, list_transform([0, 1, 2], lambda i: '<ToW>' || CASE WHEN (doc_id + i) % 9 = 0 THEN '[ERROR]' ELSE 'r' END || i || '</ToW>') AS tows FROM g0)"""


@query(f"""WITH {_GOLD}, p AS (SELECT *, list_sort(list_filter(list_transform(gold, lambda x, i: {{'pos': strpos(sentence, x) - 1, 'idx': i, 'word': x}}), lambda z: z.pos >= 0)) AS ps FROM g),
q AS (SELECT *, list_transform(ps, lambda z, i: sentence[(CASE WHEN i = 1 THEN 0 ELSE ps[i - 1].pos + length(ps[i - 1].word) END) + 1 : z.pos] || tows[z.idx] || z.word) AS parts FROM p)
SELECT doc_id, array_to_string(parts, '') || sentence[ps[len(ps)].pos + length(ps[len(ps)].word) + 1:] AS completion FROM q""")
def splice_reasoning(spark, sf_dir):
    return _gold(spark, sf_dir).select("doc_id", splice.insert(F.col("sentence"), F.col("gold_label"), F.col("tows")).alias("completion"))


@query(f"""WITH {_GOLD} SELECT doc_id, nullif(trim(sentence[1:strpos(sentence, gold[1]) - 1]), '') AS context, sentence[1:strpos(sentence, gold[2]) - 1] || tows[2] || sentence[strpos(sentence, gold[2]):] AS one,
CASE WHEN strpos(sentence[strpos(sentence, gold[1]) + length(gold[1]):], gold[2]) > 0 THEN sentence[strpos(sentence, gold[1]) + length(gold[1]):][1:strpos(sentence[strpos(sentence, gold[1]) + length(gold[1]):], gold[2]) - 1] ELSE sentence[strpos(sentence, gold[1]) + length(gold[1]):] END AS between FROM g""")
def context_before_word(spark, sf_dir):
    s, g, t = F.col("sentence"), F.col("gold_label"), F.col("tows")
    return _gold(spark, sf_dir).select("doc_id", splice.context_before(s, g).alias("context"), splice.insert_one(s, g[1], t[1]).alias("one"), splice.text_between(s, g[0], g[1]).alias("between"))


@query(f"""WITH {_GOLD}, x AS (SELECT 'f' || (doc_id % 5) AS source_file, len(gold) AS g, len(tows) AS t, len(list_filter(tows, lambda z: contains(z, '[ERROR]'))) AS e FROM g)
SELECT source_file, count(*) AS items, sum(g) AS words, sum(t) AS reasonings, sum(e) AS errors, round(100.0 * sum(e) / sum(t), 6) AS error_rate, round(100.0 * (sum(t) - sum(e)) / sum(g), 6) AS completion_rate FROM x GROUP BY ROLLUP (source_file)""")
def multi_reasoning_totals(spark, sf_dir):
    df = _gold(spark, sf_dir).withColumn("source_file", F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")))
    return corpus.reasoning_totals(df, "source_file")


# ---- answers and scores


@query(f"WITH {ANSWERS} SELECT k, first_answer, predicted_answer, ascii(predicted_answer) - 65 AS place FROM a")
def boxed_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("k", "first_answer", "predicted_answer", extract.letter_index(F.col("predicted_answer")).alias("place"))


_NUM = "[+-]?(?:\\d{1,3}(?:,\\d{3})*|\\d+)(?:\\.\\d+)?"


@query(f"""WITH n AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CASE o_orderkey % 4 WHEN 0 THEN 'so #### ' || o_orderkey || '.5 then {{' || o_custkey || '}}' WHEN 1 THEN 'x #### ' || o_orderkey WHEN 2 THEN 'it is 7' || chr(10) || 'and 1,' || (100 + o_custkey % 900) ELSE 'none' END AS t, o_custkey FROM orders)
SELECT k, CASE k % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN CAST(left(CAST(k AS VARCHAR), 3) AS DOUBLE) WHEN 2 THEN CAST(1000 + 100 + o_custkey % 900 AS DOUBLE) END AS value, coalesce(abs(CASE k % 4 WHEN 0 THEN o_custkey WHEN 1 THEN CAST(left(CAST(k AS VARCHAR), 3) AS BIGINT) WHEN 2 THEN 1100 + o_custkey % 900 END - k) < 1e-6, false) AS matches FROM n""")
def numeric_answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("u"))
    k, u, m = F.col("k").cast("string"), F.col("u").cast("string"), F.col("k") % 4
    t = F.when(m == 0, F.concat(F.lit("so #### "), k, F.lit(".5 then {"), u, F.lit("}"))).when(m == 1, F.concat(F.lit("x #### "), k)).when(m == 2, F.concat(F.lit("it is 7\nand 1,"), (100 + F.col("u") % 900).cast("string"))).otherwise("none")
    n = o.withColumn("value", extract.number(t))
    return n.select("k", "value", extract.same_number(F.col("value"), F.col("k")).alias("matches"))


@query(f"WITH {ANSWERS} SELECT model, count(*) AS total, count(predicted_answer) AS valid, count(*) FILTER (is_correct) AS correct, round(100.0 * count(*) FILTER (is_correct) / count(predicted_answer), 6) AS accuracy_standard, round(100.0 * count(*) FILTER (is_correct) / count(*), 6) AS accuracy_strict FROM a GROUP BY model")
def accuracy_standard_strict(spark, sf_dir):
    return scoring.accuracies(answers(spark, sf_dir), ["model"])


@query(f"WITH {ANSWERS} SELECT subject, count(*) AS total, count(predicted_answer) AS valid, count(*) FILTER (is_correct) AS correct, round(100.0 * count(*) FILTER (is_correct) / count(predicted_answer), 6) AS accuracy FROM a WHERE NOT starts_with(model_raw_output, 'ERROR') GROUP BY subject")
def subject_accuracy(spark, sf_dir):
    return scoring.subject_accuracy(answers(spark, sf_dir), "subject")


@query(f"""WITH {ANSWERS} SELECT CASE WHEN predicted_answer IS NULL THEN 'extraction_failed' WHEN predicted_answer = ground_truth THEN 'correct' ELSE 'incorrect_answer' END AS kind, count(*) AS n FROM a GROUP BY kind""")
def failure_kinds(spark, sf_dir):
    return answers(spark, sf_dir).groupBy(scoring.failure_kind(F.col("ground_truth"), F.col("predicted_answer")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {ANSWERS} SELECT model, count(*) AS total, count(*) FILTER (first_answer IS DISTINCT FROM predicted_answer) AS changed, count(*) FILTER (is_correct AND NOT first_correct) AS improved, count(*) FILTER (first_correct AND NOT is_correct) AS degraded FROM a GROUP BY ROLLUP (model)")
def reextract_summary(spark, sf_dir):
    return scoring.reextraction(answers(spark, sf_dir), "model", "first_answer", "predicted_answer", "ground_truth")


def _two_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All answers twice; some items have an id of their own in each run, so that the other run lacks them."""
    a = answers(spark, sf_dir).withColumn("pos", F.col("k"))
    own = lambda n, base: F.when(F.col("k") % n == 0, base - 2 * F.col("k")).otherwise(F.col("k")).alias("id")
    en = a.select(own(5, -1), "pos", "ground_truth", "predicted_answer", "is_correct")
    ko = a.select(own(7, -2), "pos", "ground_truth", F.col("first_answer").alias("predicted_answer"), F.col("first_correct").alias("is_correct"))
    return en, ko


_RUNS = f"""{ANSWERS}, en AS (SELECT CASE WHEN k % 5 = 0 THEN -1 - 2 * k ELSE k END AS id, is_correct AS x FROM a),
ko AS (SELECT CASE WHEN k % 7 = 0 THEN -2 - 2 * k ELSE k END AS id, first_correct AS y FROM a)"""


@query(f"WITH {_RUNS} SELECT id, CASE WHEN x AND NOT y THEN 'gap' WHEN y AND NOT x THEN 'reverse_gap' ELSE 'both_correct' END AS kind FROM en JOIN ko USING (id) WHERE x OR y")
def gap_split(spark, sf_dir):
    return scoring.gap_split(*_two_runs(spark, sf_dir), "id")


@query(f"WITH {_RUNS} SELECT id FROM en JOIN ko USING (id) WHERE NOT x AND NOT y")
def unsolvable_ids(spark, sf_dir):
    en, ko = _two_runs(spark, sf_dir)
    return scoring.common_ids(scoring.partition_ids(en)[1], scoring.partition_ids(ko)[1])


_SIDE = f"""{ANSWERS}, z AS (SELECT k AS id, CASE WHEN k % 5 <> 0 OR k % 7 <> 0 THEN ground_truth END AS ground_truth, CASE WHEN k % 5 = 0 THEN 'Not found' ELSE predicted_answer END AS en_answer, CASE WHEN k % 7 = 0 THEN 'Not found' ELSE first_answer END AS ko_answer,
  k % 5 <> 0 AND is_correct AS en_correct, k % 7 <> 0 AND first_correct AS ko_correct FROM a)"""


def _side(spark, sf_dir) -> DataFrame:
    en, ko = _two_runs(spark, sf_dir)
    ids = answers(spark, sf_dir).select(F.col("k").alias("id"))
    return scoring.side_by_side(ids, {"en": en, "ko": ko})


@query(f"WITH {_SIDE} SELECT id, ground_truth, en_answer, ko_answer, en_correct, ko_correct FROM z")
def reasoning_comparison(spark, sf_dir):
    return _side(spark, sf_dir)


@query(f"WITH {_SIDE} SELECT count(*) AS total, count(*) FILTER (en_answer IS NOT DISTINCT FROM ko_answer) AS agreeing, round(100.0 * count(*) FILTER (en_answer IS NOT DISTINCT FROM ko_answer) / count(*), 2) AS rate FROM z WHERE en_answer IS DISTINCT FROM 'Not found' AND ko_answer IS DISTINCT FROM 'Not found'")
def answer_agreement(spark, sf_dir):
    return scoring.agreement(_side(spark, sf_dir), "en", "ko")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def resume_unprocessed(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("id"))
    return scoring.unprocessed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), done, words=bloom.build(done, "id"))


_MODELS = f"{ANSWERS}, m AS (SELECT model, round(100.0 * count(*) FILTER (is_correct) / count(*), 6) AS metric FROM a GROUP BY model)"


def _models(spark, sf_dir) -> DataFrame:
    return scoring.accuracies(answers(spark, sf_dir), ["model"]).select("model", F.col("accuracy_strict").alias("metric"))


@query(f"""WITH {_MODELS}, r AS (SELECT *, row_number() OVER (ORDER BY metric DESC, model) AS hi, row_number() OVER (ORDER BY metric, model DESC) AS lo, count(*) OVER () AS n FROM m)
SELECT 'top' AS side, hi AS place, hi AS rank, model, metric FROM r WHERE hi <= 3 UNION ALL SELECT 'worst', lo, n - lo + 1, model, metric FROM r WHERE lo <= 3""")
def top_worst_models(spark, sf_dir):
    return scoring.top_and_worst(_models(spark, sf_dir), "metric", "model").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_MODELS}, r AS (SELECT *, round(100.0 * (rank() OVER (ORDER BY metric) - 1) / count(*) OVER (), 6) AS percentile, avg(metric) OVER () AS mean FROM m)
SELECT model, metric, percentile, CASE WHEN percentile >= 66.7 THEN 'high' WHEN percentile >= 33.3 THEN 'mid' ELSE 'low' END AS level, round(metric - mean, 6) AS from_mean FROM r""")
def model_percentile(spark, sf_dir):
    return scoring.percentile_level(_models(spark, sf_dir), "metric")


@query(f"WITH {SCORES} SELECT model, round(avg(metric), 6) AS mean, round(var_pop(metric), 6) AS variance, round(stddev_pop(metric), 6) AS std, min(metric) AS min, max(metric) AS max, round(max(metric) - min(metric), 6) AS range FROM s GROUP BY model")
def subject_variance(spark, sf_dir):
    return scoring.spread(scores(spark, sf_dir), ["model"], "metric")


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY metric DESC, subject) AS hi, row_number() OVER (PARTITION BY model ORDER BY metric, subject) AS lo FROM s)
SELECT model, subject, 'strong' AS side, CAST(hi AS INTEGER) AS place FROM r WHERE hi <= 3 UNION ALL SELECT model, subject, 'weak', CAST(lo AS INTEGER) FROM r WHERE lo <= 3""")
def subject_extremes(spark, sf_dir):
    return scoring.subject_extremes(scores(spark, sf_dir), "model", "subject", "metric")


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY metric DESC, model) AS hi FROM s) SELECT subject, model AS best, metric AS score FROM r WHERE hi = 1")
def best_per_task(spark, sf_dir):
    return scoring.best_per_task(scores(spark, sf_dir), "subject", "model", "metric")


@query(f"WITH {SCORES} SELECT model, coalesce(max(metric) FILTER (subject = 's0'), 0) AS s0, coalesce(max(metric) FILTER (subject = 's1'), 0) AS s1, coalesce(max(metric) FILTER (subject = 's99'), 0) AS s99 FROM s GROUP BY model")
def model_task_pivot(spark, sf_dir):
    return scoring.task_table(scores(spark, sf_dir), "model", "subject", "metric", ["s0", "s1", "s99"])


@query(f"WITH {SCORES} SELECT subject, round(avg(metric), 6) AS mean, CASE WHEN avg(metric) > 0.8 THEN 'Easy' WHEN avg(metric) > 0.5 THEN 'Medium' ELSE 'Hard' END AS tier FROM s GROUP BY subject")
def task_difficulty(spark, sf_dir):
    return scoring.difficulty(scores(spark, sf_dir), "subject", "metric")


@query(f"""WITH {SCORES}, c AS (SELECT subject, CAST(sum(CAST(metric AS DECIMAL(18,6))) FILTER (contains(model, '-ToW')) AS DOUBLE) / count(*) FILTER (contains(model, '-ToW')) AS a, CAST(sum(CAST(metric AS DECIMAL(18,6))) FILTER (NOT contains(model, '-ToW')) AS DOUBLE) / count(*) FILTER (NOT contains(model, '-ToW')) AS b FROM s GROUP BY subject)
SELECT subject, a AS marked, b AS base, a - b AS difference, CASE WHEN b > 0 THEN 100 * (a - b) / b ELSE 0 END AS change_pct FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def cohort_comparison(spark, sf_dir):
    return scoring.cohorts(scores(spark, sf_dir), "subject", "model", "metric")


@query(f"""WITH {SCORES}, l AS (SELECT *, CASE WHEN model LIKE '%-ToW' THEN 'ko' ELSE 'en' END AS lang FROM s), c AS (SELECT subject, CAST(sum(CAST(metric AS DECIMAL(18,6))) FILTER (lang = 'en') AS DOUBLE) / count(*) FILTER (lang = 'en') AS en, CAST(sum(CAST(metric AS DECIMAL(18,6))) FILTER (lang = 'ko') AS DOUBLE) / count(*) FILTER (lang = 'ko') AS ko FROM l GROUP BY subject)
SELECT subject, en, ko, en - ko AS difference, (en + ko) / 2 AS combined FROM c""")
def language_comparison(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("lang", F.when(F.col("model").endswith("-ToW"), "ko").otherwise("en"))
    return scoring.language_comparison(s, "subject", "lang", "metric")


@query(f"WITH {SCORES}, x AS (SELECT CASE WHEN subject <> 's3' THEN metric END AS metric FROM s) SELECT round(max(coalesce(metric, 0)), 6) AS all_max, round(min(coalesce(metric, 0)), 6) AS all_min, round(avg(coalesce(metric, 0)), 6) AS all_mean, round(avg(metric), 6) AS valid_mean, round(max(metric) - min(metric), 6) AS valid_gap FROM x")
def score_range(spark, sf_dir):
    return scoring.score_range(scores(spark, sf_dir).withColumn("metric", F.when(F.col("subject") != "s3", F.col("metric"))), "metric")


#: Result files of a task "arc": the exact key, one that contains it, none; metrics of the priority list, others, measures of errors only.
_RESULTS = ['{"arc_more": {"acc": 0.1}, "arc": {"acc": 0.4, "acc_norm": 0.5}}', '{"piqa": {"acc": 0.2}, "my_arc_easy": {"num_fewshot": 3, "zz": 7.0, "f1_stderr": 0.1, "f1": 0.25}}', '{"piqa": {"em": 0.3}, "x": {"acc": 0.9}}', '{"arc": {"alias": 1, "acc_stderr": 0.1, "_x": 0.5}}']
_METRIC = """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(list_extract(%s, CAST(o_orderkey %% 4 + 1 AS INTEGER)) AS JSON) AS j FROM orders),
t AS (SELECT k, j, coalesce(list_extract(list_filter(json_keys(j), lambda x: x = 'arc'), 1), list_extract(list_filter(json_keys(j), lambda x: contains(x, 'arc') OR contains('arc', x)), 1)%s) AS task_key FROM o),
m AS (SELECT k, task_key, json_extract(j, '$.' || task_key) AS m FROM t),
n AS (SELECT k, task_key, m, CASE WHEN list_contains(json_keys(m), 'acc_norm') THEN 'acc_norm' WHEN list_contains(json_keys(m), 'acc') THEN 'acc'
  ELSE list_extract(list_filter(json_keys(m), lambda x: NOT suffix(x, '_stderr') AND NOT prefix(x, '_') AND x NOT IN ('alias', 'num_fewshot')%s), 1) END AS metric FROM m)
SELECT k, task_key, metric, CAST(json_extract(m, '$.' || metric) AS DOUBLE) AS value FROM n"""


def _result_maps(spark, sf_dir) -> DataFrame:
    told = F.get(F.array(*map(F.lit, _RESULTS)), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.from_json(told, "map<string,map<string,double>>").alias("r"))


@query(_METRIC % (str(_RESULTS), "", ""))
def metric_resolution(spark, sf_dir):
    return scoring.resolve_metric(_result_maps(spark, sf_dir), "k", "r", "arc", ["acc_norm", "acc"])


@query(_METRIC % (str(_RESULTS), ", list_extract(json_keys(j), 1)", " AND CAST(json_extract(m, '$.' || x) AS DOUBLE) BETWEEN 0 AND 1"))
def metric_resolution_first_key(spark, sf_dir):
    return scoring.resolve_metric(_result_maps(spark, sf_dir), "k", "r", "arc", ["acc_norm", "acc"], unit_range=True, first_key=True)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 5 THEN 'dev' ELSE 'test' END AS split FROM lineitem")
def dev_test_split(spark, sf_dir):
    return corpus.first_of_each(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 5, "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def latest_of_key(spark, sf_dir):
    return scoring.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


# ---- language-understanding metrics


@query(f"""WITH {ANSWERS}, p AS (SELECT coalesce(predicted_answer, 'A') AS p, ground_truth AS t FROM a), l AS (SELECT p AS c FROM p UNION SELECT t FROM p),
x AS (SELECT c, count(*) FILTER (p = c AND t = c) AS tp, count(*) FILTER (p = c) AS pp, count(*) FILTER (t = c) AS tt FROM l, p GROUP BY c), y AS (SELECT coalesce(2.0 * tp / nullif(pp + tt, 0), 0) AS f1 FROM x)
SELECT (SELECT round(avg((p = t)::INT), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1, (SELECT round(avg((p = t)::INT), 6) FROM p) AS micro_f1 FROM y""")
def macro_micro_f1(spark, sf_dir):
    a = answers(spark, sf_dir).withColumn("p", klue.known_or(F.col("predicted_answer"), list("ABCD"), "A"))
    return klue.relation_scores(a, "p", "ground_truth")


@query(f"""WITH {DOCS}, w AS (SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM d), z AS (SELECT list_distinct(list_filter(w, lambda x, i: i % 3 = 1)) AS p, list_distinct(list_filter(w, lambda x, i: i % 2 = 1)) AS t FROM w),
x AS (SELECT len(t) AS nt, len(p) AS np, len(list_intersect(t, p)) AS tp FROM z),
y AS (SELECT sum(tp) / sum(np) AS p, sum(tp) / sum(nt) AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM y""")
def entity_prf(spark, sf_dir):
    w = text.word_list(F.col("text"))
    d = documents(spark, sf_dir).select(F.filter(w, lambda x, i: i % 3 == 0).alias("p"), F.filter(w, lambda x, i: i % 2 == 0).alias("t"))
    return klue.entity_scores(d, "p", "t")


@query(f"""WITH {DOCS}, w AS (SELECT list_filter(string_split_regex(lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g')), '\\s+'), lambda x: x <> '') AS w FROM d),
x AS (SELECT w[3:] AS p, w[1:greatest(0, len(w) - 2)] AS r FROM w), y AS (SELECT CAST(len(list_intersect(list_distinct(p), list_distinct(r))) AS DOUBLE) AS c, len(p) AS np, len(r) AS nr, p = r AS em FROM x)
SELECT round(avg(em::INT), 6) AS exact_match, round(avg(CASE WHEN np = 0 OR nr = 0 THEN (np = nr)::INT WHEN c = 0 THEN 0 ELSE 2 * (c / np) * (c / nr) / (c / np + c / nr) END), 6) AS f1 FROM y""")
def reading_em_f1(spark, sf_dir):
    w = text.word_list(klue.normal_answer(F.col("text")))
    part = lambda start, n: F.array_join(F.slice(w, start, n), " ")
    d = documents(spark, sf_dir).select(part(3, F.size(w)).alias("p"), F.array(part(1, F.greatest(F.lit(0), F.size(w) - 2))).alias("r"))
    return klue.reading_scores(d, "p", "r")


def _slots(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    slot = lambda m: F.create_map(F.lit("area"), (k % m).cast("string"), F.concat(F.lit("x"), (k % 2).cast("string")), F.lit("Yes"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select("k", slot(4).alias("p"), slot(3).alias("t"), F.lit("find").alias("pi"), F.when(k % 5 == 0, "book").otherwise("find").alias("ti"))


@query("SELECT round(count(*) FILTER (o_orderkey % 4 = o_orderkey % 3 AND o_orderkey % 5 <> 0) / count(*), 6) AS joint_goal_accuracy, round((count(*) FILTER (o_orderkey % 4 = o_orderkey % 3) + count(*)) / (2.0 * count(*)), 6) AS slot_accuracy FROM orders")
def dialogue_scores(spark, sf_dir):
    s = _slots(spark, sf_dir)
    return klue.joint_goal(s, "pi", "p", "ti", "t").crossJoin(klue.slot_accuracy(s, "p", "t"))


@query("""WITH h AS (SELECT o_orderkey % 4 = o_orderkey % 3 AS h, o_orderkey % 2 = 0 AS l FROM orders) SELECT round((count(*) FILTER (h)) / (2.0 * count(*)), 6) AS uas, round((count(*) FILTER (h AND l)) / (2.0 * count(*)), 6) AS las FROM h""")
def dependency_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    dep = lambda h, l: F.struct(h.cast("string").alias("head"), l.alias("label"))
    p = F.create_map(F.lit("w1"), dep(k % 4, F.when(k % 2 == 0, "S").otherwise("O")))
    t = F.create_map(F.lit("w1"), dep(k % 3, F.lit("S")), F.lit("w2"), dep(F.lit(1), F.lit("S")))
    return klue.attachment(table(spark, sf_dir, "orders").select(p.alias("p"), t.alias("t")), "p", "t")


@query("SELECT round(coalesce(corr(o_orderkey % 97, o_custkey % 89), 0), 6) AS pearson, count(*) AS n FROM orders")
def similarity_pearson(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).cast("double").alias("a"), (F.col("o_custkey") % 89).cast("double").alias("b"))
    return klue.pearson(o, "a", "b")


@query(f"WITH {ANSWERS} SELECT round(count(*) FILTER (predicted_answer IS NOT NULL) / count(*), 6) AS success_rate FROM a")
def run_success(spark, sf_dir):
    return klue.success_rate(answers(spark, sf_dir), "predicted_answer")


# ---- chat and mixing


@query("""WITH m AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN '<|assistant|>' || chr(10) || trim(text) || '</s>' || chr(10) ELSE '<|' || role || '|>' || chr(10) || trim(text) || chr(10) END, '' ORDER BY turn, role, text) AS t FROM (SELECT conv_id, turn, CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id)
SELECT conv_id, regexp_replace(t, '\n$', '') AS rendered FROM m""")
def chat_render(spark, sf_dir):
    role = F.when(F.col("role").isin("system", "user", "assistant"), F.col("role")).otherwise("user")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    m = c.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return m.select("conv_id", F.regexp_replace(mixing.render(F.col("messages")), "\n$", "").alias("rendered"))


@query("SELECT doc_id, [lang, text] AS contents, ['user', 'assistant'] AS roles FROM documents")
def conversation_to_messages(spark, sf_dir):
    d = mixing.to_messages(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query"), F.col("text").alias("response")))
    return d.select("doc_id", F.transform("messages", lambda m: m["content"]).alias("contents"), F.transform("messages", lambda m: m["role"]).alias("roles"))


@query("SELECT 'customer' AS dataset, (SELECT count(*) // 4 FROM customer) AS n UNION ALL SELECT 'supplier', (SELECT count(*) // 2 FROM supplier)")
def mix_by_fraction(spark, sf_dir):
    src = {"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))}
    return mixing.mix(src, {"customer": 0.25, "supplier": 0.5}, "key", ["key"]).distinct().groupBy("dataset").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS dataset, least(40, (SELECT count(*) FROM customer)) AS n UNION ALL SELECT 'supplier', least(7, (SELECT count(*) FROM supplier))")
def mix_by_count(spark, sf_dir):
    src = {"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))}
    return mixing.mix(src, {"customer": 40, "supplier": 7}, "key", ["key"]).distinct().groupBy("dataset").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang || CASE WHEN regexp_matches(text, '^\\s|^$') OR regexp_matches(lang, '\\s$') OR lang = '' THEN '' ELSE ' ' END || text || '</s>' AS joined FROM documents")
def prompt_completion_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mixing.joined(F.col("lang"), F.col("text")).alias("joined"))


@query("SELECT vec_id, list_position(list_transform(embedding, lambda x: x > 0.2), true) - 1 AS f FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) > 0 UNION ALL SELECT vec_id, len(embedding) FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) = 0")
def first_true_index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", mixing.first_true(F.transform("embedding", lambda x: x > 0.2)).cast("long").alias("f"))


# ---- representation


_SIM = EMB + """, n AS (SELECT a.idx, b.idx AS other, list_cosine_similarity(a.v, b.v) AS sim, a.lang AS la, b.lang AS lb FROM e a JOIN e b ON a.idx <> b.idx)"""


@query(f"WITH {_SIM}, r AS (SELECT idx, other, row_number() OVER (PARTITION BY idx ORDER BY round(sim, 9) DESC, other) AS rank, round(sim, 6) AS sim FROM n) SELECT idx, other, CAST(rank AS INTEGER) AS rank, sim FROM r WHERE rank <= 3")
def cosine_knn(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return neighbours.nearest(e, e, 3).select("idx", "other", "rank", F.round("sim", 6).alias("sim"))


@query(f"WITH {_SIM}, r AS (SELECT idx, arg_max(other, {{'s': round(sim, 9), 'o': -other}}) AS o FROM n GROUP BY idx) SELECT count(*) AS n, round(avg((o = CASE WHEN idx % 2 = 0 THEN idx + 1 ELSE idx - 1 END)::INT), 6) AS accuracy FROM r")
def retrieval_accuracy(spark, sf_dir):
    return representation.retrieval(embedded(spark, sf_dir))


@query(f"WITH {_SIM} SELECT idx AS i, other AS j, round(sim, 6) AS sim FROM n WHERE idx < other AND sim >= 0.4")
def similar_pairs(spark, sf_dir):
    return neighbours.similar(embedded(spark, sf_dir), 0.4).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH {EMB}, n AS (SELECT a.idx, b.idx AS other, list_cosine_similarity(a.v, b.v) AS s, list_cosine_similarity(a.train, b.train) AS t FROM e a JOIN e b ON a.idx <> b.idx),
r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY round(s, 9) DESC, other) AS rs, row_number() OVER (PARTITION BY idx ORDER BY round(t, 9) DESC, other) AS rt FROM n)
SELECT round(count(*) FILTER (rs <= 5 AND rt <= 5) / ((SELECT count(*) FROM e) * 5.0), 6) AS consistency FROM r""")
def neighbour_consistency(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return representation.neighbour_consistency(e.select("idx", "v"), e.select("idx", F.col("train").alias("v")))


@query(f"""WITH {EMB}, w AS (SELECT idx, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v, list_transform(train, lambda y: y / sqrt(list_dot_product(train, train))) AS t FROM e),
f AS (SELECT a.idx AS i, list_avg(max(list_dot_product(a.v, b.t), 10)) AS rx FROM w a, w b GROUP BY a.idx), g AS (SELECT b.idx AS j, list_avg(max(list_dot_product(a.v, b.t), 10)) AS ry FROM w a, w b GROUP BY b.idx)
SELECT idx, round(2 * list_dot_product(v, t) - rx - ry, 6) AS csls FROM w JOIN f ON f.i = idx JOIN g ON g.j = idx""")
def csls(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return representation.csls(e.select("idx", "v"), e.select("idx", F.col("train").alias("v")))


@query(f"WITH {EMB} SELECT a.idx // 2 AS pair_id, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON b.idx = a.idx + 1 AND a.idx % 2 = 0")
def pair_distance(spark, sf_dir):
    return representation.pair_distances(embedded(spark, sf_dir))


@query(f"""WITH {EMB}, g AS (SELECT lang, list_distance(v, train) AS g, list_cosine_similarity(v, train) AS c FROM e) SELECT lang, round(avg(g), 6) AS mean_gap, round(avg(c), 6) AS mean_cosine, round(regr_slope(c, g), 6) AS slope, round(regr_intercept(c, g), 6) AS intercept, round(corr(g, c), 6) AS correlation,
CASE WHEN abs(corr(g, c)) >= 0.7 THEN 'strong' WHEN abs(corr(g, c)) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, round(quantile_cont(g, 0.25), 6) AS q1, round(quantile_cont(g, 0.75), 6) AS q3, round(avg(1 / (1 + g)), 6) AS consistency FROM g GROUP BY lang""")
def gap_panels(spark, sf_dir):
    return representation.gap_panels(embedded(spark, sf_dir), "lang")


@query(f"WITH {EMB}, c AS (SELECT lang, label, count(*) AS n FROM e GROUP BY ALL) SELECT lang, label, n FROM c")
def cluster_contingency(spark, sf_dir):
    return representation.contingency(embedded(spark, sf_dir), "lang", "label")


@query(f"WITH {EMB}, c AS (SELECT lang, label, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY lang) AS t FROM c) SELECT lang, label AS cluster, round(n / t, 6) AS purity FROM r WHERE r = 1")
def cluster_purity(spark, sf_dir):
    return representation.purity(embedded(spark, sf_dir), "lang", "label")


@query(f"WITH {_SIM} SELECT least(la, lb) AS a, greatest(la, lb) AS b, round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity FROM n GROUP BY ALL")
def language_similarity(spark, sf_dir):
    return representation.language_similarity(embedded(spark, sf_dir))


@query()
def representation_statistics(spark, sf_dir):
    """CKA, SVCCA, Procrustes and PCA of two models' vectors, from one pass of moments."""
    m = factors.factors(embedded(spark, sf_dir), "base", "train")
    p = m.procrustes()
    rows = [("cka", m.cka()), ("svcca", m.svcca()), ("procrustes_scale", p["scale"]), ("procrustes_error", p["error"]), ("pca_explained_1", float(m.pca()["explained"][0]))]
    return spark.createDataFrame([(n, round(x, 6)) for n, x in rows], "statistic string, value double")


@query()
def kmeans_quality(spark, sf_dir):
    c = representation.kmeans(embedded(spark, sf_dir), 10)
    return spark.createDataFrame([(k, round(x, 6)) for k, x in representation.clustering_agreement(c, "label", "cluster").items()], "statistic string, value double")


# ---- confidence and attention


@query(f"""WITH {PROBS}, q AS (SELECT *, -list_sum(list_transform(probs, lambda x: x * ln(x))) AS h, list_reverse_sort(probs) AS s FROM p)
SELECT text_id, pos, round(h, 6) AS entropy, CASE WHEN h < 2 THEN 'low' WHEN h < 4 THEN 'medium' WHEN h < 6 THEN 'high' ELSE 'very_high' END AS level, round(list_var_pop(probs), 6) AS variance, round(s[1], 6) AS top1, round(list_sum(s[1:5]), 6) AS topk, round(pow(2, h / ln(2)), 6) AS perplexity FROM q""")
def token_confidence(spark, sf_dir):
    p = confidence.positions(token_probs(spark, sf_dir))
    return p.select("text_id", "pos", F.round("entropy", 6).alias("entropy"), "level", *(F.round(c, 6).alias(c) for c in ("variance", "top1", "topk", "perplexity")))


@query(f"""WITH {PROBS}, s AS (SELECT text_id, pos, list_reverse_sort(probs) AS s FROM p), u AS (SELECT text_id, pos, unnest(range(1, len(s) + 1)) AS i, s FROM s) SELECT text_id, pos, CAST(min(i) AS INTEGER) AS nucleus FROM u WHERE list_sum(s[1:i]) >= 0.95 GROUP BY ALL""")
def nucleus_size(spark, sf_dir):
    return token_probs(spark, sf_dir).select("text_id", "pos", vectors.nucleus(F.col("probs")).alias("nucleus"))


@query(f"WITH {PROBS}, q AS (SELECT text_id, -list_sum(list_transform(probs, lambda x: x * ln(x))) AS h FROM p) SELECT text_id, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, round(max(h), 6) AS max, round(min(h), 6) AS min, round(max(h) - min(h), 6) AS range FROM q GROUP BY text_id")
def entropy_summary(spark, sf_dir):
    return confidence.text_summary(confidence.positions(token_probs(spark, sf_dir)))


@query(f"WITH {PROBS}, q AS (SELECT text_id, pos, -list_sum(list_transform(probs, lambda x: x * ln(x))) AS h FROM p), r AS (SELECT *, avg(h) OVER w AS m, stddev_pop(h) OVER w AS s FROM q WINDOW w AS (PARTITION BY text_id)) SELECT text_id, pos, CASE WHEN h > m + s THEN 'high' ELSE 'low' END AS kind FROM r WHERE h > m + s OR h < m - s")
def uncertain_positions(spark, sf_dir):
    return confidence.outliers(confidence.positions(token_probs(spark, sf_dir))).select("text_id", "pos", "kind")


@query(f"WITH {PROBS} SELECT text_id, round(exp(-sum(list_sum(list_transform(probs, lambda x: ln(x + 1e-8)))) / sum(len(probs))), 6) AS perplexity FROM p GROUP BY text_id")
def overall_perplexity(spark, sf_dir):
    return confidence.overall_perplexity(token_probs(spark, sf_dir))


@query(f"""WITH {PROBS}, h AS (SELECT text_id, lang, avg(-list_sum(list_transform(probs, lambda x: x * ln(x)))) AS m FROM p GROUP BY ALL), j AS (SELECT a.text_id, a.m AS en, b.m AS ko, a.m * 0.9 AS en2, b.m * 1.1 AS ko2 FROM h a JOIN h b ON a.text_id = b.text_id AND a.lang = 'en' AND b.lang = 'ko')
SELECT round(avg(abs(en - ko)), 6) AS base_difference, round(avg(abs(en2 - ko2)), 6) AS tuned_difference, round(avg(abs(en - ko) - abs(en2 - ko2)), 6) AS improvement, round(avg((ko > en)::INT), 6) AS ko_share, count(*) FILTER (abs(en2 - ko2) < abs(en - ko)) AS improved FROM j""")
def language_bias(spark, sf_dir):
    h = confidence.positions(token_probs(spark, sf_dir)).groupBy("text_id", "lang").agg(F.avg("entropy").alias("m"))
    j = h.where("lang = 'en'").select("text_id", F.col("m").alias("en")).join(h.where("lang = 'ko'").select("text_id", F.col("m").alias("ko")), "text_id").withColumns({"en2": F.col("en") * 0.9, "ko2": F.col("ko") * 1.1})
    return confidence.language_bias(j, ("en", "ko"), ("en2", "ko2"))


@query(f"WITH {ATT}, r AS (SELECT layer, head, i, sum(-w * ln(w + 1e-8)) AS e FROM att GROUP BY ALL) SELECT layer, head, round(avg(e), 6) AS entropy FROM r GROUP BY ALL")
def attention_head_entropy(spark, sf_dir):
    return attention.head_entropy(attention_blocks(spark, sf_dir))


@query(f"WITH {ATT}, m AS (SELECT layer, i, j, avg(w) AS w FROM att GROUP BY ALL), r AS (SELECT layer, i, sum(-w * ln(w + 1e-8)) AS e FROM m GROUP BY ALL) SELECT layer, round(avg(e), 6) AS entropy FROM r GROUP BY layer")
def attention_layer_entropy(spark, sf_dir):
    return attention.layer_entropy(attention_blocks(spark, sf_dir))


@query(f"WITH {ATT}, r AS (SELECT layer, head, i, sum(w * abs(j - i)) AS d FROM att GROUP BY ALL) SELECT layer, head, round(avg(d), 6) AS distance FROM r GROUP BY ALL")
def attention_distance(spark, sf_dir):
    return attention.distance(attention_blocks(spark, sf_dir))


@query(f"WITH {ATT} SELECT layer, head, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(max(w), 6) AS max FROM att WHERE i = j GROUP BY ALL")
def self_attention(spark, sf_dir):
    return attention.self_attention(attention_blocks(spark, sf_dir))


@query(f"WITH {ATT}, s AS (SELECT layer, j, sum(w) AS s FROM att GROUP BY ALL) SELECT layer, j, round(s / sum(s) OVER (PARTITION BY layer), 6) AS importance, CAST(row_number() OVER (PARTITION BY layer ORDER BY round(s, 9) DESC, j) AS INTEGER) AS rank FROM s")
def token_importance(spark, sf_dir):
    return attention.token_importance(attention_blocks(spark, sf_dir))


@query(f"WITH {ATT} SELECT layer, round(sum(CASE WHEN j > i THEN w ELSE 0 END) / sum(w), 6) AS forward, round(sum(CASE WHEN j < i THEN w ELSE 0 END) / sum(w), 6) AS backward, round(sum(CASE WHEN abs(j - i) <= 2 THEN w ELSE 0 END) / sum(w), 6) AS local FROM att GROUP BY layer")
def attention_flow(spark, sf_dir):
    return attention.flow(attention_blocks(spark, sf_dir))


@query(f"""WITH {ATT}, {_att('btt', '5')}, p AS (SELECT layer, i, j, avg(w) AS x FROM att GROUP BY ALL), q AS (SELECT layer, i, j, avg(w) AS y FROM btt GROUP BY ALL)
SELECT layer, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine, round(avg(pow(x - y, 2)), 6) AS mse, round(corr(x, y), 6) AS correlation FROM p JOIN q USING (layer, i, j) GROUP BY layer""")
def attention_comparison(spark, sf_dir):
    return attention.compare_layers(attention_blocks(spark, sf_dir), attention_blocks(spark, sf_dir, 1.0))


@query(f"""WITH {ATT}, {_att('btt', '5')}, p AS (SELECT layer, i, j, avg(w) AS x FROM att WHERE j < 60 GROUP BY ALL), q AS (SELECT layer, i, j, avg(w) AS y FROM btt WHERE i % 5 <> 0 GROUP BY ALL),
z AS (SELECT layer, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM p FULL JOIN q USING (layer, i, j))
SELECT layer, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine, round(avg(pow(x - y, 2)), 6) AS mse, round(corr(x, y), 6) AS correlation FROM z GROUP BY layer""")
def attention_comparison_padded(spark, sf_dir):
    """Of a model that sees 60 places and one that lacks each fifth row."""
    short = F.transform("heads", lambda h: F.struct(h["head"].alias("head"), F.slice(h["w"], 1, 60).alias("w")))
    return attention.compare_layers(attention_blocks(spark, sf_dir).withColumn("heads", short), attention_blocks(spark, sf_dir, 1.0).where("i % 5 != 0"), pad=True)


# ---- data of figures, panels of pairs and languages


@query(f"""WITH {DOCS}, r AS (SELECT min(words) AS lo, max(words) AS hi FROM d), b AS (SELECT CAST(least(19, floor((words - lo) / CAST(hi - lo AS DOUBLE) * 20)) AS INTEGER) AS bin, count(*) AS n FROM d, r GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) * CAST(i AS DOUBLE) / 20, 6) AS low, round(lo + (hi - lo) * CAST(i + 1 AS DOUBLE) / 20, 6) AS high, coalesce(n, 0) AS n FROM range(20) AS t(i), r LEFT JOIN b ON b.bin = i""")
def equal_width_bins(spark, sf_dir):
    return panels.equal_bins(documents(spark, sf_dir), "words")


@query(f"""WITH {DOCS}, q AS (SELECT lang, quantile_cont(words, [0.25, 0.5, 0.75]) AS q FROM d GROUP BY lang), x AS (SELECT d.lang, words, q, words BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside FROM d JOIN q ON d.lang IS NOT DISTINCT FROM q.lang)
SELECT lang, count(*) AS n, round(any_value(q)[1], 6) AS q1, round(any_value(q)[2], 6) AS median, round(any_value(q)[3], 6) AS q3, min(words) FILTER (inside) AS low, max(words) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS outside FROM x GROUP BY lang""")
def length_boxes(spark, sf_dir):
    return panels.boxes(documents(spark, sf_dir), "words", ["lang"])


@query(f"WITH {ATT} SELECT i AS row, j AS \"column\", round(avg(w), 6) AS value FROM att GROUP BY ALL")
def attention_heat(spark, sf_dir):
    return panels.heat(attention.long(attention_blocks(spark, sf_dir)), "i", "j", "w")


@query(f"WITH {PROBS}, q AS (SELECT lang, pos, -list_sum(list_transform(probs, lambda x: x * ln(x))) AS h FROM p) SELECT lang, pos, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, count(h) AS n FROM q GROUP BY ALL")
def entropy_curve(spark, sf_dir):
    return panels.curve(confidence.positions(token_probs(spark, sf_dir)), "pos", "entropy", ["lang"])


@query(f"""WITH {EMB}, u AS (SELECT lang, unnest(range(len(v))) AS d, unnest(list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))) AS x FROM e), s AS (SELECT lang, d, sum(x) AS x FROM u GROUP BY ALL),
t AS (SELECT lang, sum(x * x) AS dot FROM s GROUP BY lang), n AS (SELECT lang, count(*) AS n FROM e GROUP BY lang) SELECT lang, round((n * n - dot) / (n * n), 6) AS distance FROM t JOIN n USING (lang)""")
def intra_language_distance(spark, sf_dir):
    return representation.intra_distance(embedded(spark, sf_dir))


@query(f"""WITH {EMB}, u AS (SELECT label, unnest(range(len(v))) AS d, unnest(v) AS x FROM e), c AS (SELECT label, d, avg(x) AS x FROM u GROUP BY ALL), l AS (SELECT label, list(x ORDER BY d) AS x FROM c GROUP BY label)
SELECT p.label AS a, q.label AS b, round(1 - list_cosine_similarity(p.x, q.x), 6) AS distance FROM l p JOIN l q ON p.label < q.label""")
def label_centre_distances(spark, sf_dir):
    return representation.centre_distances(embedded(spark, sf_dir), "label")


@query(f"""WITH {EMB}, k AS (SELECT p.idx // 2 AS pair_id, CASE WHEN p.v <> q.v AND p.train <> q.train THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cka FROM e p JOIN e q ON p.idx % 2 = 0 AND q.idx = p.idx + 1)
SELECT arg_min(pair_id, (-cka, pair_id)) AS best_pair, max(cka) AS best, arg_min(pair_id, (cka, pair_id)) AS worst_pair, min(cka) AS worst, round(var_pop(cka), 6) AS variance FROM k""")
def sentence_pair_cka(spark, sf_dir):
    return representation.pair_cka_panel(representation.pair_cka(embedded(spark, sf_dir)))


@query(f"""WITH {PROBS}, m AS (SELECT text_id, lang, avg(-list_sum(list_transform(probs, lambda x: x * ln(x)))) OVER (PARTITION BY text_id, lang) AS h, text_id % 11 = 0 AND lang = 'ko' AS failed FROM p),
t AS (SELECT text_id, avg(h) FILTER (lang = 'en' AND NOT failed) AS x, avg(h) FILTER (lang = 'ko' AND NOT failed) AS y, bool_or(failed) AS failed FROM (SELECT DISTINCT * FROM m) GROUP BY text_id)
SELECT round(avg(x), 6) AS mean_a, round(stddev_pop(x), 6) AS std_a, count(x) AS n_a, round(avg(y), 6) AS mean_b, round(stddev_pop(y), 6) AS std_b, count(y) AS n_b, count(*) FILTER (failed) AS errors, count(*) AS total,
round(avg(x) - avg(y), 6) AS difference, CASE WHEN count(x) = count(y) THEN round(corr(x, y), 6) END AS correlation FROM t""")
def language_statistics(spark, sf_dir):
    p = confidence.positions(token_probs(spark, sf_dir)).groupBy("text_id", "lang").agg(F.avg("entropy").alias("entropy"))
    return confidence.language_statistics(p.withColumn("failed", (F.col("text_id") % 11 == 0) & (F.col("lang") == "ko")), "entropy")


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by rank of each layer and step, of events."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("step"), (F.col("event_id") % 12).alias("layer"), F.col("event_type").alias("token")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("step", "layer")
    return e.select("step", "layer", "token", F.row_number().over(w.orderBy(F.desc("n"), "token")).alias("rank"), (F.col("n") / F.sum("n").over(w)).alias("prob"))


LENS = """n AS (SELECT user_id % 50 AS step, event_id % 12 AS layer, event_type AS token, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT step, layer, token, n / sum(n) OVER (PARTITION BY step, layer) AS prob, row_number() OVER (PARTITION BY step, layer ORDER BY n DESC, token) AS rank FROM n),
z AS (SELECT t.step, layer, token, round(prob, 6) AS prob, token = arg_max(token, layer) OVER (PARTITION BY t.step) AS is_final FROM t WHERE rank = 1)"""


@query(f"WITH {LENS} SELECT * FROM z")
def layer_lens(spark, sf_dir):
    return confidence.lens_table(lens(spark, sf_dir))


@query(f"WITH {LENS}, o AS (SELECT step, max(layer) FILTER (NOT is_final) AS other FROM z GROUP BY step) SELECT step, min(layer) AS layer FROM z JOIN o USING (step) WHERE other IS NULL OR layer > other GROUP BY step")
def lens_settled(spark, sf_dir):
    return confidence.lens_settled(lens(spark, sf_dir))
