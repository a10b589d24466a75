"""A training-corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing; each stage judged on its own input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, packing, simhash, suffixes, toxicity
from corpusloom.llm.common import order_key, row_hash, written
from corpusloom.llm.queries import VOCABULARY, fold, table


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows (d, row: order of the id, hash of the text) of `bad`: each row goes by its own text, whatever others share its id."""
    bad = bad.select(F.col("d").alias("__d"), F.col("row").alias("__row")).distinct()
    return docs.join(bad, (order_key(docs["doc_id"]) == F.col("__d")) & (row_hash(docs["text"]) == F.col("__row")), "left_anti")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(order_key(docs["doc_id"]).alias("d"), row_hash(docs["text"]).alias("row"), docs["text"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, by a model of the labelled documents that aren't held out. Rows without an id, or with one that others
    have too, are judged by their own text."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return _without(docs, toxicity.score(_rows(docs), model, ("d", "row")).where("score >= 0.5"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with letters, the larger part of which is one known language; judged by their own text like drop_toxic's."""
    profiles = language.fit(docs.where(fold("doc_id", 3) != 1))
    told = language.identify(_rows(docs), profiles, ("d", "row"))
    return _without(docs, told.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < 0.5)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id (no id: last), then of the least hash of the text; equal rows are one.

    Near-duplicates are those of 3 bits of SimHash, and all pairs of a 5-word Jaccard of 0.8 or more.
    """
    return simhash.first_of_groups(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text without passages that came before, each row's own whatever others share its id; a character that loses a byte goes
    whole; n_chars follows. Rows without an id count as last."""
    told = suffixes.remove_repeats(docs, characters=True, whole_row=True)
    clean, lost = F.col("kept").cast("string"), F.size("spans") > 0
    out = {"text": F.when(lost, clean).otherwise(F.col("own.text")), "n_chars": F.when(lost, F.length(clean).cast("long")).otherwise(F.col("own.n_chars"))}
    return told.select(*(out.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = packing.pieces(docs, public_tokenizers.path(VOCABULARY))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", one_of_each), ("repeats", cut_repeats), ("packing", pack)]
#: Models, hash components and bin packing are not for SQL: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
