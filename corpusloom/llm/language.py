"""Language identification as a mixture: EM over n-gram likelihoods, and a language set chosen by penalised likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_arrays, key_schema, keyed_texts, rows_of

#: Documents a language that the profiles are fitted on at most, by order of a hash.
SAMPLE = 600
#: Slots of hashed n-grams of GRAMS characters; a language's profile has this fixed size.
SLOTS, GRAMS, SMOOTH = 1 << 16, 3, 0.2
STEPS, UNKNOWN = 12, "und"
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Slots of the 3-grams (over characters; letters lower-cased, all else a blank, runs of blanks as one)."""
    codes = np.frombuffer(f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode("utf-32-le", "replace"), "<u4").astype("u8")
    if len(codes) < GRAMS:
        return np.zeros(0, "i8")
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype("i8")


class Profiles:
    """log P(slot | language), of a fixed size whatever the corpus."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTH
        self.p = (p / p.sum(axis=1, keepdims=True)).T.copy() if len(languages) else np.zeros((SLOTS, 0))

    def mixture(self, text: str) -> tuple[str, float, dict[str, float]]:
        """(language, its share of the mixture, shares of the chosen languages)."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, {}
        found = grams(text)
        slots, n = (np.nonzero(all_n := np.bincount(found, minlength=SLOTS))[0], None) if len(found) > 4096 else np.unique(found, return_counts=True)
        n = (all_n[slots] if n is None else n).astype("f8")
        like, total = self.p[slots], float(n.sum())
        single = n @ np.log(like)
        chosen, best, shares = [int(np.argmax(single))], float(single.max()), np.ones(1)
        penalty = 0.5 * np.log(max(total, 2.0))
        while len(chosen) < len(self.languages):
            # the likelihood is concave in the share, so its slope at share 0 bounds what a language can add
            mixed = like[:, chosen] @ shares
            slope = (n / mixed) @ like - total
            slope[chosen] = -np.inf
            k = int(np.argmax(slope))
            if slope[k] <= penalty:
                break
            trial = [*chosen, k]
            part, pi = like[:, trial], np.append(0.8 * shares, 0.2)
            for _ in range(STEPS):
                pi = pi * ((n / (part @ pi)) @ part) / total
            value = float(n @ np.log(part @ pi))
            if value - best <= penalty:
                break
            chosen, shares, best = trial, pi, value
        told = {self.languages[c]: float(s) for c, s in zip(chosen, shares)}
        top = max(told, key=lambda x: (told[x], x))
        return top, min(1.0, told[top]), told


def fit(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from text and lang of the rows given, at most `sample` documents a language (in the order of a hash of the
    text), each whole: a bounded fit. Null languages and null texts teach nothing."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    least = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    # a first cut by hash, even and map-side, so that the exact order is only made of few rows; copies share a hash, so
    # that the share is of distinct texts
    counts = {r["lang"]: r["n"] for r in least.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, SLOTS)))
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * (sample + 50) / n))).otherwise(share)
    cut = least.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share).dropDuplicates(["lang", "h"])
    kept = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample).drop("r", "h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                made.setdefault(lang, np.zeros(SLOTS, "i8"))
                made[lang] += np.bincount(grams(text.as_py()), minlength=SLOTS)
        for lang, c in made.items():
            slots = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([slots.astype("<i4").tobytes()], pa.binary()), pa.array([c[slots].astype("<i8").tobytes()], pa.binary())], names=["lang", "slots", "n"])

    parts = kept.select("lang", "text").mapInArrow(count, "lang string, slots binary, n binary").collect()
    languages = sorted({r["lang"] for r in parts if r["slots"]})  # one without a letter in its texts has no profile
    table = np.zeros((len(languages), SLOTS))
    for r in parts:
        if not r["slots"]:
            continue
        table[languages.index(r["lang"]), np.frombuffer(r["slots"], "<i4")] += np.frombuffer(r["n"], "<i8")
    return Profiles(languages, table)


def identify(docs: DataFrame, profiles: Profiles, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key columns (long), lang_pred, score, shares (map of the chosen languages) of every whole text.

    `und` with score 0 for a text that is null or has no letter, or where no language was learned; short
    texts are judged like others. Null and repeated doc_ids are kept; no rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages times SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in rows_of(batches, key=key):
            lang, score, shares = zip(*map(model.mixture, texts))
            yield pa.RecordBatch.from_arrays([*key_arrays(ids, key), pa.array(lang), pa.array(score, pa.float64()), pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))], names=[*key, "lang_pred", "score", "shares"])

    return keyed_texts(docs, key).mapInArrow(run, f"{key_schema(key)}, lang_pred string, score double, shares map<string,double>")
