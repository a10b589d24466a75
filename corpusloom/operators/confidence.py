"""Confidence of token distributions: entropy, top-k, nucleus, perplexity, comparisons of models and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v


def r6(c) -> Column:
    return F.round(c, 6)


def positions(df: DataFrame, probs: str = "probs", k: int = 5) -> DataFrame:
    """Per position: entropy and its level, variance, top-k mass and share, nucleus size, perplexity."""
    p = v.normalised(F.col(probs))
    out = df.withColumn("__p", p).withColumn("entropy", v.entropy(F.col("__p")))
    top = v.total(v.top_values(F.col("__p"), k))
    return out.withColumns({"level": level(F.col("entropy")), "variance": v.variance(F.col("__p")), "top1": F.array_max("__p"), "topk": top, "top1_share": F.array_max("__p") / top, "nucleus": v.nucleus(F.col("__p")), "perplexity": F.pow(F.lit(2.0), F.col("entropy") / F.ln(F.lit(2.0)))}).drop("__p")


def level(entropy: Column) -> Column:
    return F.when(entropy < 2, "low").when(entropy < 4, "medium").when(entropy < 6, "high").otherwise("very_high")


def text_summary(pos: DataFrame, text: str = "text_id") -> DataFrame:
    e = F.col("entropy")
    return pos.groupBy(text).agg(r6(F.avg(e)).alias("mean"), r6(F.stddev_pop(e)).alias("std"), r6(F.max(e)).alias("max"), r6(F.min(e)).alias("min"), r6(F.max(e) - F.min(e)).alias("range"))


def outliers(pos: DataFrame, text: str = "text_id") -> DataFrame:
    """Positions strictly beyond one (population) standard deviation from their text's mean."""
    s = pos.groupBy(text).agg(F.avg("entropy").alias("__m"), F.stddev_pop("entropy").alias("__s"))
    kind = F.when(F.col("entropy") > F.col("__m") + F.col("__s"), "high").when(F.col("entropy") < F.col("__m") - F.col("__s"), "low")
    return pos.join(s, text).withColumn("kind", kind).where("kind is not null").drop("__m", "__s")


def overall_perplexity(df: DataFrame, probs: str = "probs", text: str = "text_id") -> DataFrame:
    """exp of minus the mean log(p + 1e-8) over all entries of the vocabulary."""
    logs = df.select(text, v.total(F.transform(v.doubles(F.col(probs)), lambda x: F.ln(x + 1e-8))).alias("l"), F.size(probs).alias("n"))
    return logs.groupBy(text).agg(r6(F.exp(-F.sum("l") / F.sum("n"))).alias("perplexity"))


def token_entropy(df: DataFrame, probs: str = "probs", k: int = 10, text: str = "text_id", pos: str = "pos") -> DataFrame:
    """df with the entropy of each position, its k largest values, and whether it is the last of its text."""
    last = df.groupBy(F.col(text).alias("__t")).agg(F.max(pos).alias("__last"))
    out = df.withColumns({"token_entropy": v.entropy(F.col(probs), 1e-8), "top": v.top_values(F.col(probs), k)}).join(last, F.col(text).eqNullSafe(F.col("__t")))
    return out.withColumn("is_last", F.col(pos) == F.col("__last")).drop("__t", "__last")


def bin_counts(values: Column, bins: int = 10) -> Column:
    """How many values are in each of `bins` bins of equal width from the least to the largest (which the last one holds); all alike: a range of 1 around them."""
    x = v.doubles(values)
    low, high = F.array_min(x), F.array_max(x)
    ends = F.struct(F.when(low == high, low - 0.5).otherwise(low).alias("low"), F.when(low == high, high + 0.5).otherwise(high).alias("high"))
    place = lambda e: F.transform(x, lambda y: F.least(F.lit(bins - 1), F.floor((y - e["low"]) / (e["high"] - e["low"]) * bins)))
    return v.bound(ends, lambda e: v.bound(place(e), lambda at: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda y: y == b)))))


def histogram_information(a: Column, b: Column, bins: int = 10) -> Column:
    """Mutual information (natural log) of the histograms of two arrays, bin by bin, where how full a bin is counts as its label."""
    both = F.arrays_zip(bin_counts(a, bins).alias("x"), bin_counts(b, bins).alias("y"))
    same = lambda z, of: F.size(F.filter(z, of))
    part = lambda z, e: F.ln(bins * same(z, lambda o: (o["x"] == e["x"]) & (o["y"] == e["y"])) / (same(z, lambda o: o["x"] == e["x"]) * same(z, lambda o: o["y"] == e["y"])))
    return v.bound(both, lambda z: v.total(F.transform(z, lambda e: part(z, e))) / bins)


def compare(a: DataFrame, b: DataFrame, key: list[str], metric: str = "entropy") -> DataFrame:
    """Mean difference of two models, and the correlation at equal positions, which only runs of equal length have."""
    one = a.agg(F.count("*").alias("na"), F.avg(metric).alias("ma"), F.stddev_pop(metric).alias("sa")).crossJoin(F.broadcast(b.agg(F.count("*").alias("nb"), F.avg(metric).alias("mb"), F.stddev_pop(metric).alias("sb"))))
    j = a.select(*key, F.col(metric).alias("x")).join(b.select(*key, F.col(metric).alias("y")), key).agg(F.count("*").alias("n"), v.correlation("x", "y").alias("r"))
    alike = (F.col("na") == F.col("nb")) & (F.col("n") == F.col("na"))
    return one.crossJoin(F.broadcast(j)).select("n", r6("ma").alias("mean_a"), r6("mb").alias("mean_b"), r6(F.col("mb") - F.col("ma")).alias("delta"), r6(F.col("sb") - F.col("sa")).alias("delta_std"), r6(F.when(alike, F.nanvl("r", F.lit(None).cast("double")))).alias("correlation"))


def across_languages(df: DataFrame, lang: str = "lang", metric: str = "entropy", pos: str = "pos") -> DataFrame:
    """One text a language (the last): the most and least confident language and the variance between them."""
    one = df.groupBy(lang).agg(F.max_by(metric, pos).alias("m"))
    return one.agg(F.min_by(lang, F.struct("m", lang)).alias("most_confident"), F.max_by(lang, F.struct(F.col("m"), F.col(lang))).alias("least_confident"), r6(F.var_pop("m")).alias("variance"))


def hidden_uncertainty(norms: Column, attention_entropy: Column | None = None) -> dict[str, Column]:
    """Fallback from hidden-state norms: 1 / (1 + norm / 100), its band and a pseudo-perplexity."""
    u = F.transform(v.doubles(norms), lambda x: 1 / (1 + x / 100))
    mean = v.total(u) / F.size(u)
    out = {"uncertainty": mean, "band": F.when(mean < 0.3, "low").when(mean < 0.6, "medium").otherwise("high"), "pseudo_perplexity": F.exp(2 * mean), "high_positions": v.bound(mean + F.sqrt(v.variance(u)), lambda most: F.size(F.filter(u, lambda x: x > most)))}
    return out | ({"attention_entropy": attention_entropy} if attention_entropy is not None else {})


def target_confidence(df: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Mean of the texts' means by model and language."""
    text = df.groupBy(*by, "text_id").agg(F.avg(p).alias("m"))
    return text.groupBy(*by).agg(r6(F.avg("m")).alias("confidence"))


def improvement(conf: DataFrame, model: str, base: str, tuned: str) -> DataFrame:
    pick = lambda name, lang: F.avg(F.when((F.col(model) == name) & (F.col("lang") == lang), F.col("confidence")))
    en, ko = pick(tuned, "en") - pick(base, "en"), pick(tuned, "ko") - pick(base, "ko")
    return conf.agg(r6(en).alias("en"), r6(ko).alias("ko"), r6((en + ko) / 2).alias("overall"))


def language_bias(pairs: DataFrame, base: tuple[str, str], tuned: tuple[str, str], placeholders: bool = False) -> DataFrame:
    """pairs with EN and KO uncertainties of two models: mean absolute differences, improvement, share of pairs where KO is larger, improved pairs.

    A pair that lacks any of the four has failed: it is left out, or with `placeholders` counts with a difference of 0.1 in both models, KO as
    the larger and no improvement."""
    failed = F.col(base[0]).isNull() | F.col(base[1]).isNull() | F.col(tuned[0]).isNull() | F.col(tuned[1]).isNull()
    b, t = (F.when(failed, 0.1).otherwise(F.abs(F.col(x) - F.col(y))) for x, y in (base, tuned))
    ko = failed | (F.col(base[1]) > F.col(base[0]))
    rows = pairs if placeholders else pairs.where(~failed)
    return rows.agg(r6(F.avg(b)).alias("base_difference"), r6(F.avg(t)).alias("tuned_difference"), r6(F.avg(b - t)).alias("improvement"), r6(F.avg(ko.cast("double"))).alias("ko_share"), F.count_if(t < b).alias("improved"))


def extreme_pairs(pairs: DataFrame, en: str, ko: str, pair: str = "pair_id") -> DataFrame:
    d = F.abs(F.col(en) - F.col(ko))
    return pairs.agg(F.min_by(pair, F.struct(-d, F.col(pair))).alias("largest"), F.min_by(pair, F.struct(d, F.col(pair))).alias("smallest"))


def language_statistics(df: DataFrame, metric: str, text: str = "text_id", lang: str = "lang", a: str = "en", b: str = "ko", failed: str = "failed") -> DataFrame:
    """Comparisons of many texts in two languages in one row: mean, deviation and number of each language (0 without any),
    texts where either failed, all texts, the difference of the means and the correlation over texts.

    df has a row for each text and language (attention: the mean over layers; confidence: the mean difference of entropy); a failed
    row counts in no mean. Difference and correlation need both languages, the correlation equal numbers.
    """
    x = lambda name: F.avg(F.when((F.col(lang) == name) & ~F.col(failed), F.col(metric)))
    texts = df.groupBy(text).agg(x(a).alias("x"), x(b).alias("y"), F.max(failed).alias("failed"))
    some = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    out = texts.agg(
        some(F.avg("x")).alias("mean_a"), some(F.stddev_pop("x")).alias("std_a"), F.count("x").alias("n_a"), some(F.avg("y")).alias("mean_b"), some(F.stddev_pop("y")).alias("std_b"), F.count("y").alias("n_b"),
        F.count_if("failed").alias("errors"), F.count("*").alias("total"), r6(F.avg("x") - F.avg("y")).alias("difference"), r6(v.correlation("x", "y")).alias("correlation"),
    )
    return out.withColumn("correlation", F.when(F.col("n_a") == F.col("n_b"), F.col("correlation")))


def lens_table(df: DataFrame) -> DataFrame:
    """df (step, layer, rank from 1, token, prob) -> step, layer, token and prob on top, and whether it is the last layer's token."""
    top = df.where("rank = 1").select("step", "layer", "token", "prob")
    last = top.groupBy("step").agg(F.max_by("token", "layer").alias("final"))
    return top.join(last, "step").select("step", "layer", "token", r6("prob").alias("prob"), F.col("token").eqNullSafe(F.col("final")).alias("is_final"))


def lens_settled(df: DataFrame) -> DataFrame:
    """Per step the first layer from which on the final token stays on top."""
    t = lens_table(df)
    last_other = t.groupBy("step").agg(F.max(F.when(~F.col("is_final"), F.col("layer"))).alias("other"))
    return t.join(last_other, "step").where("other is null or layer > other").groupBy("step").agg(F.min("layer").alias("layer"))
