"""Helpers shared by the operators of this subpackage: row keys and blocks of Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, written  # noqa: F401  (for the operators)

#: What a null doc_id counts as where rows are ordered by id: larger than all others.
LAST = (1 << 63) - 1


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns of any name are of no account."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def keyed_texts(docs: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns (long) and the text (null: empty) alone."""
    return docs.select(*(docs[k].cast("long").alias(k) for k in key), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def key_arrays(ids: list, key: tuple[str, ...]) -> list[pa.Array]:
    """The columns of what rows_of gives as ids."""
    return [pa.array(x, pa.int64()) for x in ([ids] if len(key) == 1 else zip(*ids))]


def key_schema(key: tuple[str, ...]) -> str:
    return ", ".join(f"{k} long" for k in key)


def order_key(doc_id):
    """The id by which rows are ordered; null ids come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def row_hash(text):
    """Tells rows of one doc_id apart; rows of equal id and text are one document."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def rows_of(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20, key: tuple[str, ...] = ("doc_id",)) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most about `chars` characters each; a longer text comes alone. Bounds what a task holds.

    More than one key column: the ids are tuples."""
    for batch in batches:
        ids, texts, held = [], [], 0
        column = batch.column("text")
        keys = [batch.column(k).to_pylist() for k in key]
        for i, doc_id in enumerate(keys[0] if len(keys) == 1 else zip(*keys)):
            text = column[i].as_py() or ""
            if ids and held + len(text) > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
        if ids:
            yield ids, texts
