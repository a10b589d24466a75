"""Importance resampling towards a target's distribution of hashed word n-grams, in two Arrow passes over the texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, order_key, row_hash, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of text that are cut into words at a time; a longer word comes whole.
SEGMENT = 1 << 22
#: Lengths of words whose tables of the checksum are laid out side by side.
SHORT = 64
POLYNOMIAL = 0xEDB88320

#: Bytes of words: digits, letters of ASCII, and all bytes of other characters.
WORD = bytes(b >= 0x80 or chr(b).isalnum() for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables (4 x 256 for the bytes of a checksum) that append n zero bytes: for n under SHORT, and for powers of two from SHORT on."""
    one = np.arange(256, dtype="u4")
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(POLYNOMIAL), one >> 1)
    table = np.stack([np.arange(256, dtype="u4") << np.uint32(8 * j) for j in range(4)])
    short = [table]
    for _ in range(SHORT):
        table = one[table & 255] ^ table >> 8
        short.append(table)
    powers = [short.pop()]
    while len(powers) < 26:
        powers.append(_apply(powers[-1].ravel(), 0, powers[-1]))
    return np.concatenate([t.ravel() for t in short]), powers


def _apply(tables: np.ndarray, at, c: np.ndarray) -> np.ndarray:
    return tables[at + (c & 255)] ^ tables[at + 256 + (c >> 8 & 255)] ^ tables[at + 512 + (c >> 16 & 255)] ^ tables[at + 768 + (c >> 24)]


def followed(crc: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc32 of texts one after another, from those of both and the length of the second."""
    short, powers = _shifts()
    out = _apply(short, (length % SHORT) * 1024, crc)
    left, k = length // SHORT, 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(powers[k].ravel(), 0, out[odd])
        left, k = left >> 1, k + 1
    return out ^ then


def _inside(text: bytes) -> np.ndarray:
    return np.frombuffer(text.translate(WORD), bool)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row of each feature in the array, its bucket, how many are single words), by segments of bounded size; texts without nulls.

    Features are words, and neighbouring words joined by one blank; words are lower-cased (A-Z alone) runs of WORD's bytes."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", "u1")
    a, end = int(offsets[0]), int(offsets[-1])
    blank = np.uint32(zlib.crc32(b" "))
    last: tuple[int, np.uint32] | None = None  # the row of the word before the segment, and the checksum of it and a blank
    while a < end:
        b = min(a + SEGMENT, end)
        limit = int(offsets[np.searchsorted(offsets, b)])
        while b < limit:  # on to the word's or the text's end
            gap = np.flatnonzero(~_inside(data[b : min(b + SEGMENT, limit)].tobytes()))
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + SEGMENT, limit)
        own = data[a:b].tobytes()
        inside = np.zeros(len(own) + 2, bool)
        inside[1:-1] = _inside(own)
        cut = np.zeros(len(own) + 1, bool)
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        rows = np.searchsorted(offsets, a + starts, "right") - 1
        a = b
        if not len(starts):
            continue
        length = ends - starts
        bounds = np.concatenate(([0], np.cumsum(length)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.frombuffer(own.translate(LOWER), "u1")[inside[1:-1]])])
        coded = words.dictionary_encode()
        which, (_, at, distinct) = coded.indices.to_numpy(), coded.dictionary.buffers()
        distinct, at = distinct.to_pybytes(), np.frombuffer(at, "i8")[: len(coded.dictionary) + 1].tolist()
        single = np.array([zlib.crc32(distinct[i:j]) for i, j in zip(at, at[1:])], "u4")
        spaced = followed(single, np.full(len(single), blank), np.ones(len(single), "i8"))[which]
        single = single[which]
        before, before_row = np.roll(spaced, 1), np.roll(rows, 1)
        before_row[0], before[0] = last or (-1, np.uint32(0))
        last = int(rows[-1]), spaced[-1]
        two = np.flatnonzero(rows == before_row)
        double = followed(before[two], single[two], length[two])
        yield np.concatenate((rows, rows[two])), np.concatenate((single, double)) % np.uint32(BUCKETS), len(rows)


def _texts(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (column text; null: none) are in each bucket: one vector a partition, merged by a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, "i8")
        for batch in batches:
            for _, buckets, _ in features(batch.column("text")):
                counts += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    parts = _texts(texts).mapInArrow(run, "counts binary").rdd
    if not parts.getNumPartitions():
        return np.zeros(BUCKETS, "i8")
    return parts.map(lambda r: np.frombuffer(r["counts"], "i8")).treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed shares of each bucket, rounded down."""
    s, t = source.astype("f8"), target.astype("f8")
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype("i8")


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_features, weight (the mean gain of the features, rounded down; none: 0) of every whole text.

    A null text counts as empty; null and repeated doc_ids get a row each; an empty table gives none; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            number, single, total = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n)
            for rows, buckets, words in features(batch.column("text")):
                number += np.bincount(rows, minlength=n)
                single += np.bincount(rows[:words], minlength=n)
                total += np.bincount(rows, weights=shared.value[buckets], minlength=n)  # whole numbers, exact in doubles
            weight = total.astype("i8") // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(single), pa.array(number), pa.array(weight)], names=["doc_id", "row", "n_words", "n_features", "weight"])

    own = _texts(docs, docs["doc_id"].cast("long").alias("doc_id"), row_hash(docs["text"]).alias("row"))
    return own.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Thousandths of a Gumbel number that only depends on the id (null: as an empty string) and the seed, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weigh's columns, score (weight and noise) and rank: 1, 2, 3 ... for the drawn documents, null for the others.

    Of the N documents of at least `least_words` words floor(percent * N / 100) are drawn without replacement, by the Gumbel trick:
    those of the highest scores, ties to the smaller doc_id (null: last), then to the smaller hash of the text. docs and target need a
    column text, docs a doc_id; nulls, empty texts, repeated ids and empty tables as in weigh (an empty target's shares are all alike).

    Ranks come without one sort of all rows: a score's rows are ordered among themselves and start after the number of all higher
    ones. Only the number of rows of each score reaches the driver: whole numbers between -50,000 and 70,000, as both counts are
    64-bit numbers and the noise has 2 ** 32 values."""
    with Scratch(docs.sparkSession) as scratch:
        gain = gains(bucket_counts(docs), bucket_counts(target))
        told = scratch.written(weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
        fit = F.col("n_words") >= least_words
        number = {r["score"]: r["n"] for r in told.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}
        drawn = percent * sum(number.values()) // 100
        before, higher = [], 0
        for score in sorted(number, reverse=True):
            if higher < drawn:
                before.append((score, higher))
            higher += number[score]
        starts = docs.sparkSession.createDataFrame(before, "score long, higher long")
        within = F.row_number().over(Window.partitionBy("score").orderBy(order_key(F.col("doc_id")), "row"))
        least = before[-1][0] if before else None
        high = told.where(fit & (F.col("score") >= F.lit(least).cast("long")))
        ranked = high.join(F.broadcast(starts), "score").withColumn("rank", F.col("higher") + within).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        others = told.where(~F.coalesce(fit & (F.col("score") >= F.lit(least).cast("long")), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
        return written(ranked.select(*others.columns).unionByName(others), "resampled")


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents that resample draws, with all their columns; rows that are equal in id and text go together."""
    told = resample(docs, target, percent, least_words, seed).where("rank IS NOT NULL").select(order_key(F.col("doc_id")).alias("d2"), F.col("row").alias("row2"))
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("own"), order_key(docs["doc_id"]).alias("d"), row_hash(docs["text"]).alias("row"))
    return own.join(told, (F.col("d") == F.col("d2")) & (F.col("row") == F.col("row2")), "left_semi").select("own.*")
