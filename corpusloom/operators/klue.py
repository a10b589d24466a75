"""Metrics of the language-understanding tasks, from flat prediction and reference columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_answer, word_list
from ..functions.vectors import bound, correlation


def zip_positions(predictions: DataFrame, references: DataFrame, pos: str = "pos") -> DataFrame:
    return predictions.join(references, pos)


def _confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(predicted).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """class, precision, recall, f1, support over the labels of either side; undefined values are 0."""
    c = _confusion(df, predicted, truth)
    parts = c.select(F.explode(F.array(F.struct(F.col("p").alias("class"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("pp"), F.lit(0).cast("long").alias("tt")), F.struct(F.col("t").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("pp"), F.col("n").alias("tt")))).alias("x")).select("x.*")
    s = parts.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("tt").alias("support")).where("class is not null")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("support"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")


def relation_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """accuracy (of labels without blanks around them), macro and micro F1 (of labels as they are)."""
    macro = per_class(df, predicted, truth).agg(F.avg("f1").alias("macro_f1"))
    n, same = F.count("*"), F.count_if(F.col(predicted) == F.col(truth))
    trimmed = F.count_if(F.regexp_replace(predicted, r"(?U)^\s+|\s+$", "") == F.regexp_replace(truth, r"(?U)^\s+|\s+$", ""))
    return df.agg((trimmed / n).alias("accuracy"), (same / n).alias("micro_f1")).crossJoin(F.broadcast(macro)).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "micro_f1")))


def known_or(predicted: Column, labels: list[str], default: str) -> Column:
    """Predictions outside the labels count as one class."""
    return F.when(predicted.isin(*labels), predicted).otherwise(default)


def entity_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Micro precision, recall and F1 of two array columns as sets."""
    p, t = F.array_distinct(F.col(predicted)), F.array_distinct(F.col(truth))
    s = df.select(F.size(F.array_intersect(p, t)).alias("tp"), F.size(p).alias("np"), F.size(t).alias("nt")).agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("nt").alias("nt"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("np")), "recall": ratio(F.col("tp"), F.col("nt"))})
    return s.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"))


def attachment(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """UAS and LAS over the union of tokens; columns are map<token, struct(head, label)>."""
    tokens = F.array_union(F.map_keys(predicted), F.map_keys(truth))
    rows = df.select(F.explode(tokens).alias("token"), F.col(predicted).alias("p"), F.col(truth).alias("t"))
    p, t = F.try_element_at(F.col("p"), F.col("token")), F.try_element_at(F.col("t"), F.col("token"))
    head = F.coalesce(p["head"], F.lit("")) == F.coalesce(t["head"], F.lit(""))
    label = F.coalesce(p["label"], F.lit("")) == F.coalesce(t["label"], F.lit(""))
    return rows.agg(F.round(F.count_if(head) / F.count("*"), 6).alias("uas"), F.round(F.count_if(head & label) / F.count("*"), 6).alias("las"))


def answer_em(predicted: Column, references: Column) -> Column:
    return F.exists(references, lambda r: normal_answer(r) == normal_answer(predicted)).cast("double")


def answer_f1(predicted: Column, references: Column) -> Column:
    """Overlap of the sets of words over the lengths of the lists (repeats lower it), the best of the references."""

    def score(n: Column) -> Column:
        precision, recall = n["both"] / F.nullif(n["p"], F.lit(0)), n["both"] / F.nullif(n["r"], F.lit(0))
        empty = (n["p"] == 0) | (n["r"] == 0)
        return F.when(empty, (n["p"] == n["r"]).cast("double")).when(n["both"] == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))

    def one(p: Column, r: Column) -> Column:
        return bound(F.struct(F.size(F.array_intersect(p, r)).cast("double").alias("both"), F.size(p).alias("p"), F.size(r).alias("r")), score)

    words = lambda x: word_list(normal_answer(x))
    return bound(words(predicted), lambda p: F.array_max(F.transform(references, lambda x: bound(words(x), lambda r: one(p, r)))))


def reading_scores(df: DataFrame, predicted: str, references: str) -> DataFrame:
    p, r = F.col(predicted), F.col(references)
    return df.agg(F.round(F.avg(answer_em(p, r)), 6).alias("exact_match"), F.round(F.avg(answer_f1(p, r)), 6).alias("f1"))


def _lowered(slots: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(slots), lambda e: F.struct(F.lower(e["key"]), F.lower(e["value"]))))


def joint_goal(df: DataFrame, p_intent: str, p_slots: str, t_intent: str, t_slots: str) -> DataFrame:
    ok = F.col(p_intent).eqNullSafe(F.col(t_intent)) & (_lowered(F.col(p_slots)) == _lowered(F.col(t_slots)))
    return df.agg(F.round(F.count_if(ok) / F.count("*"), 6).alias("joint_goal_accuracy"))


def slot_accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Of all keys of either side; an absent one is ''."""
    keys = F.array_union(F.map_keys(predicted), F.map_keys(truth))
    rows = df.select(F.explode(keys).alias("k"), F.col(predicted).alias("p"), F.col(truth).alias("t"))
    same = F.lower(F.coalesce(F.try_element_at("p", F.col("k")), F.lit(""))) == F.lower(F.coalesce(F.try_element_at("t", F.col("k")), F.lit("")))
    return rows.agg(F.round(F.count_if(same) / F.count("*"), 6).alias("slot_accuracy"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """r (NaN and too few rows: 0) and the number of rows."""
    return df.agg(F.round(F.coalesce(correlation(a, b), F.lit(0.0)), 6).alias("pearson"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of r for n rows by Student's t (NaN: 1): the regularised incomplete beta function by its continued fraction."""
    if n < 3 or r != r or abs(r) >= 1:
        return 0.0 if n >= 3 and abs(r) >= 1 else 1.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d = 1 / (d if abs(d) > tiny else tiny)
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def success_rate(df: DataFrame, output: str, failed_matches: bool = False) -> DataFrame:
    """Share of samples with an output. failed_matches: count blanks as right, as a run that compares '' with '' does."""
    ok = F.coalesce(F.col(output), F.lit("")) != ""
    return df.agg(F.round(F.count_if(ok | F.lit(failed_matches)) / F.count("*"), 6).alias("success_rate"))


def dependency_heads(heads: Column) -> Column:
    return F.array_join(F.transform(heads, lambda h: h.cast("string")), " ")


def last_user_state(dialogue: Column) -> Column:
    return F.try_element_at(F.filter(dialogue, lambda t: t["role"] == "user"), F.lit(-1))["state"]


def first_answer(answers: Column) -> Column:
    return F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit("답할 수 없음"))


def clamp_score(score: Column) -> Column:
    found = score.cast("string").try_cast("double")
    return F.when(found.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.0), found)))
