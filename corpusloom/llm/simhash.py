"""SimHash near-duplicates by meet-in-the-middle ball hashing over half-words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, key_arrays, key_schema, keyed_texts, order_key, row_hash, rows_of, written
from ..operators.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Members of a half-word's group from which on the group is dealt out by quarter-words too. Which links are found doesn't depend on it.
LARGE = 256


def fingerprint(text: str) -> int:
    """64-bit SimHash: majority (over half) of the XXH64 bits of 3-word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split()  # of bytes: A-Z alone, and the six ASCII blanks alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: 1 - SHINGLE - 0 or None]))[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    h, ones = np.array(hashes, "<u8").view("u1").reshape(-1, 8), np.zeros(64, "i8")
    for a in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key columns (long), fp (64 bits as a signed long) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, key=key):
            fps = np.array([fingerprint(t) for t in texts], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*key_arrays(ids, key), pa.array(fps)], names=[*key, "fp"])

    return keyed_texts(docs, key).mapInArrow(run, f"{key_schema(key)}, fp long")


def _half(fp, i: int):
    return F.shiftrightunsigned(fp, 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))


def links(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """distinct (fp, rep): pairs (u, v) of reps whose fingerprints differ in 1 to RADIUS bits, each pair at least once.

    Of three differing bits at most one lies in one of the two halves (half the radius, rounded down). So
    each fingerprint emits each half as it is, and all 33 variants of each half within one bit; they
    meet in a shuffle on (half, variant) and are verified. Groups of more than `large` members are dealt
    out again by the other half's quarters, of which one also differs in one bit at most.
    """
    fp = F.col("fp")
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _half(fp, i).alias("own"), _half(fp, 1 - i).alias("other")) for i in (0, 1))))
    exact = distinct.select("fp", "rep", half.alias("h")).select("fp", "rep", "h.other", F.col("h.own").bitwiseOR(F.shiftleft(F.col("h.i").cast("long"), 32)).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    variants = exact.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), F.col("other").alias("other2"), F.explode(F.transform(flips, lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    crowded = exact.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key")
    if not crowded.limit(1).count():
        met = exact.drop("other").hint("shuffle_hash").join(variants.drop("other2"), "key").where(near)
        return met.select(F.col("rep").alias("u"), F.col("rep2").alias("v"))
    crowded = written(crowded, "crowded")
    quarter = lambda c: F.array(*(F.shiftrightunsigned(F.col(c), 16 * j).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(j << 16)) for j in (0, 1)))
    narrow = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(16)))
    a = exact.join(crowded, "key", "left_anti").drop("other").join(variants.drop("other2"), "key").where(near)
    e = exact.join(crowded, "key").withColumn("q", F.explode(quarter("other")))
    v = variants.join(crowded, "key").withColumn("q0", F.explode(quarter("other2"))).withColumn("q", F.explode(F.transform(narrow, lambda x: F.col("q0").bitwiseXOR(x))))
    b = e.drop("other").join(v.drop("other2", "q0"), ["key", "q"]).where(near)
    return a.unionByName(b.select(*a.columns)).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """fps (fp, any other columns) -> fp, root: the distinct fingerprints, each with the least one (as a signed number) that it reaches over links."""
    distinct = written(fps.select("fp").distinct().withColumn("rep", F.col("fp")), "distinct")
    found = components(links(distinct))
    return distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most RADIUS bits, itself included).

    Documents of one fingerprint are collapsed first. Null and empty texts, and texts without words, have
    fingerprint 0. Rows with a null doc_id link others like any row, but name no component unless they are alone (then null);
    repeated doc_ids give a row each; an empty table gives none; other columns are ignored.
    """
    own = written(fingerprints(docs), "fingerprints")
    groups = written(fingerprint_groups(own).select(F.col("fp").alias("fp2"), "root"), "groups")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(groups, F.col("fp") == F.col("fp2")).groupBy("root").agg(F.min("rep").alias("component_id"))
    told = groups.join(least.withColumnRenamed("root", "root2"), F.col("root") == F.col("root2")).select("fp2", "component_id")
    return own.join(told, own.fp == told.fp2, "left").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """fingerprints' columns, and sid, n, sketch: a hash, the size and the minima of the set of 5-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, key=key):
            fps = np.array([fingerprint(t) for t in texts], "u8").view("i8")
            sets = [shingles.shingle_hashes(shingles.words_of(t)) for t in texts]
            told = [shingles.sketch(s) for s in sets]
            more = [pa.array([t[0] for t in told], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([t[1] for t in told], pa.binary())]
            yield pa.RecordBatch.from_arrays([*key_arrays(ids, key), pa.array(fps), *more], names=[*key, "fp", "sid", "n", "sketch"])

    return keyed_texts(docs, key).mapInArrow(run, f"{key_schema(key)}, fp long, sid long, n long, sketch binary")


def first_of_groups(docs: DataFrame, block: int = shingles.BLOCK) -> DataFrame:
    """docs with all its columns, one row of each group of near-duplicates: the first by doc_id (a null one last), then by a hash of the
    text; of rows that are equal in both the least one by all columns. So rows without an id, and equal rows, go like any others.

    Linked are texts whose fingerprints differ in RADIUS bits at most, and texts of a 5-word Jaccard of 0.8 or more; a group is all
    that is reached over links. Texts without words are one group; texts of fewer than five words have one shingle."""
    key = {"d": order_key(docs["doc_id"]), "row": row_hash(docs["text"])}
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.written(sketches(docs.select("text", *(v.alias(k) for k, v in key.items())), ("d", "row")), "sketches")
        sets = own.groupBy("sid", "n").agg(F.min(F.struct("d", "row")).alias("f"), F.min("sketch").alias("sketch"))
        sets = scratch.written(sets, "sets")

        def texts(asked: DataFrame) -> DataFrame:
            first = sets.join(asked, "sid").select("sid", F.col("f.d").alias("d2"), F.col("f.row").alias("row2"))
            rows = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *(v.alias(k) for k, v in key.items()))
            return rows.join(first, (F.col("d") == F.col("d2")) & (F.col("row") == F.col("row2"))).groupBy("sid").agg(F.first("text").alias("text"))

        groups = fingerprint_groups(own).select(F.col("fp").alias("fp2"), "root")
        rooted = scratch.written(own.select("fp", "sid").distinct().join(groups, F.col("fp") == F.col("fp2")).select("root", "sid").distinct(), "rooted")
        least = rooted.groupBy("root").agg(F.min("sid").alias("v")).withColumnRenamed("root", "root2")
        known = scratch.written(rooted.join(least, F.col("root") == F.col("root2")).select(F.col("sid").alias("u"), "v").where("u != v"), "known")
        found = components(known.unionByName(shingles.links(sets.select("sid", "n", "sketch"), texts, known, scratch, block)))
        parts = sets.select("sid", "f").join(found, F.col("sid") == F.col("node"), "left")
        firsts = parts.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("f").alias("f"))
        rows = own.groupBy("d", "row").agg(F.count("*").alias("n"))
        kept = written(firsts.select("f.*").join(rows, ["d", "row"]).select(F.col("d").alias("d2"), F.col("row").alias("row2"), "n"), "firsts")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("own"), *(v.alias(k) for k, v in key.items()))
    pick = lambda of: whole.join(kept.where(of), (F.col("d") == F.col("d2")) & (F.col("row") == F.col("row2")))
    out = pick("n = 1").select("own")
    if kept.where("n > 1").limit(1).count():  # else the texts needn't be read again
        out = out.unionByName(pick("n > 1").groupBy("d", "row").agg(F.min("own").alias("own")).select("own"))
    return out.select("own.*")
