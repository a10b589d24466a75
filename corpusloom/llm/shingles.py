"""Links between texts of a 5-word Jaccard of 0.8 or more: the second way of the pipeline's near-duplicate stage, beside the 3 bits of SimHash.

Such texts differ in some ten of 64 SimHash bits: ball hashing would need about 800 rows a document for them. So candidates
meet by bands of MinHash and are verified by their exact sets of shingles. Sets of which a bucket leaves more pairs open than a few forests
settle meet once more, by prefixes of their rarest shingles, which loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from ..operators.components import components

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: A pair at 0.8 shares one of 16 bands of 4 minima with a probability of 0.9998.
BANDS, ROWS = 16, 4
#: Least share of equal minima for a pair to be verified: four standard deviations under 0.8.
LEAST = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
#: From this share of equal minima on a pair is taken to pass; pairs under it in a forest are backed up by those of FORESTS further ones. Either only decides
#: which sets are left to the prefixes, not which are linked.
SURE, FORESTS = 0.95, 4
#: Counters of the rarity of shingles, whatever their number: shingles that share one count together.
COUNTERS = 1 << 18
#: Groups of each level of the tree that adds the counters up.
LEVELS = (256, 16, 1)
#: Members of a band's bucket that are compared in one task (on average).
BLOCK = 256
_RANDOM = np.random.default_rng(SEED)
_A, _B = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct XXH64 of the 5-word shingles, sorted; fewer words: of the whole sequence; no words: none."""
    if not words:
        return np.array([], "u8")
    last = max(1, len(words) - WORDS + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + WORDS]), SEED) for i in range(last)], "u8"))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """A hash of the whole set as a signed long (no shingles: 0), and its minima under the fixed functions."""
    if not len(hashes):
        return 0, b""
    least = np.full(len(_A), np.iinfo("u4").max, "u4")
    for a in range(0, len(hashes), 4096):
        part = (hashes[a : a + 4096, None] * _A + _B) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0).astype("u4"))
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - (1 << 63), least.astype("<u4").tobytes()


def _forest(table: pa.Table) -> pa.Table:
    """(key, sid, n, sketch) of one block -> key, u, v: the pairs of spanning forests, of greatest estimated similarity, over the pairs that may
    reach 0.8; and without v the sets of other such pairs, that no sure pairs link."""
    key = table["key"][0].as_py()
    rows = table.select(["sid", "n", "sketch"]).to_pylist()
    rows = sorted({r["sid"]: r for r in rows}.values(), key=lambda r: r["sid"])
    own = np.array([np.frombuffer(r["sketch"], "<u4") for r in rows], "u4").reshape(len(rows), -1)
    n = np.array([r["n"] for r in rows], "f8")
    found = []
    for i in range(len(rows) - 1):
        same = (own[i + 1 :] == own[i]).mean(axis=1)
        fits = (same >= LEAST) & (np.minimum(n[i], n[i + 1 :]) >= SIMILARITY * np.maximum(n[i], n[i + 1 :]))
        found += [(-same[k], i, i + 1 + int(k)) for k in np.flatnonzero(fits)]
    found.sort()
    u, v, sure, used = [], [], [], set()

    def top(x, root):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for turn in range(1 + FORESTS):
        root = {}
        for i, j in sure:  # what surely is one needs no further pairs
            root[top(i, root)] = top(j, root)
        added = []
        for same, i, j in found:
            a, b = top(i, root), top(j, root)
            if (i, j) not in used and a != b:
                root[a] = b
                added.append((same, i, j))
        if not added:
            break
        used |= {(i, j) for _, i, j in added}
        sure += [(i, j) for same, i, j in added if -same >= SURE]
        u += [rows[i]["sid"] for _, i, _ in added]
        v += [rows[j]["sid"] for _, _, j in added]
    root = {}
    for i, j in sure:
        root[top(i, root)] = top(j, root)
    left = {x for _, i, j in found if (i, j) not in used and top(i, root) != top(j, root) for x in (i, j)}
    u += [rows[i]["sid"] for i in sorted(left)]
    v += [None] * len(left)
    return pa.table({"key": pa.array([key] * len(u), pa.int64()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for i in range(batch.num_rows):
            a, b = (shingle_hashes(words_of(batch.column(c)[i].as_py() or "")) for c in ("text_u", "text_v"))
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both and both >= SIMILARITY * (len(a) + len(b) - both):
                u.append(batch.column("u")[i].as_py())
                v.append(batch.column("v")[i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def links(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], known: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """sets (sid, n, sketch: distinct sets of shingles), texts (gives sid, text: one a set, of the sids asked for), known (u, v: links there already) -> verified (u, v).

    Each bucket of a band is dealt by a hash into blocks, in which forests of the likeliest pairs are found; their pairs are
    verified by exact sets. Open is then a bucket of several blocks, or with pairs besides the forests', whose sets aren't one component. The
    sets of open buckets meet by prefixes, all with all (see by_prefixes). What may be lost is a pair that shares no band. Rows grow with the sets and
    their shingles, not with the pairs of a bucket.
    """
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * 4 * ROWS + 1, F.lit(4 * ROWS)))).alias("band", "part")
    keys = scratch.written(sets.where("n > 0").select("sid", "n", bands).select(F.xxhash64("band", "part").alias("key"), "sid", "n"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / block).alias("blocks"))
    own = scratch.written(keys.join(sizes, "key").select("key", "sid", "blocks", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).alias("b")), "members")
    scratch.free("keys")
    sketched = own.join(sets.select("sid", "n", "sketch"), "sid").select("key", "b", "sid", "n", "sketch")
    told = scratch.written(sketched.groupBy("key", "b").applyInArrow(_forest, "key long, u long, v long"), "told")
    found = _verified(told.where("v IS NOT NULL").select("u", "v"), texts, scratch)
    doubtful = own.where("blocks > 1").select("key", "sid").unionByName(told.where("v IS NULL").select("key", F.col("u").alias("sid")))
    if not doubtful.limit(1).count():
        return found
    comps = scratch.written(components(known.select("u", "v").unionByName(found)), "comps")
    placed = doubtful.join(comps, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("comp"))
    several = placed.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("several")).where("several").select("key")
    open_ = scratch.written(placed.join(several, "key", "left_semi").select("sid", "comp").distinct(), "open")
    if not open_.limit(1).count():
        return found
    whole = texts(open_.select("sid")).join(open_, "sid").mapInArrow(_sets, "sid long, comp long, n long, shingles binary")
    return found.unionByName(by_prefixes(scratch.written(whole, "whole"), scratch))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            sets = [shingle_hashes(words_of(text or "")) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("comp"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["sid", "comp", "n", "shingles"])


def _least_common(n: int | np.ndarray, m: int | np.ndarray):
    """How many shingles sets of n and m have in common at least if their Jaccard is SIMILARITY or more (a hair less, for rounding)."""
    return np.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9)


def by_prefixes(whole: DataFrame, scratch: Scratch) -> DataFrame:
    """whole (sid, comp, n, shingles: sorted 64-bit hashes) -> all pairs (u, v) of different comp with a Jaccard of SIMILARITY or more.

    Under one order of all shingles, the rarest first, two such sets share a shingle among the first n - ceil(0.8 n) + 1 of the larger set and, as the smaller one
    is no longer, among a still shorter prefix of the smaller one. So sets emit a row for each shingle of their prefix; rows of one shingle meet if the
    sizes and the places in both sets leave room for enough common shingles, and if their comps differ: of each shingle's rows those outside of its
    largest comp meet all others. Rarity is counted in COUNTERS counters of all sets, which only steers how long the lists are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, "i8")
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u8")
            counts += np.bincount((h % COUNTERS).astype("i8"), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(COUNTERS, "i8")
        for raw in table["counts"]:
            counts += np.frombuffer(raw.as_py(), "<i8")
        return pa.table({"counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()), "place": table["place"][:1]})

    parts = whole.select("shingles").mapInArrow(counted, "counts binary").withColumn("place", F.spark_partition_id())
    for groups in LEVELS:
        parts = parts.withColumn("place", F.col("place") % groups).groupBy("place").applyInArrow(add, "counts binary, place int")
    shared = whole.sparkSession.sparkContext.broadcast(np.minimum(np.frombuffer(parts.first()["counts"], "<i8"), np.iinfo("u4").max).astype("u4"))  # of fixed size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(a, 256)
                n = batch.column("n").to_numpy()
                most = (n - np.ceil(SIMILARITY * n - 1e-9) + 1).astype("i8")
                first = []
                for raw, k in zip(batch.column("shingles").to_pylist(), most.tolist()):
                    h = np.frombuffer(raw, "<u8")
                    first.append(h[np.lexsort((h, shared.value[(h % COUNTERS).astype("i8")]))[:k]].view("i8"))
                i = np.concatenate([np.arange(k) for k in most])
                index = i < np.repeat(n - _least_common(n, n) + 1, most)
                columns = [np.concatenate(first), *(np.repeat(batch.column(c).to_numpy(), most) for c in ("sid", "comp", "n")), i, index]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "sid", "comp", "n", "i", "index"])

    rows = scratch.written(whole.mapInArrow(prefixes, "h long, sid long, comp long, n long, i long, index boolean"), "prefixes")
    parts = rows.groupBy("h", "comp").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps"))
    lists = parts.where("comps > 1").select("h", F.col("most.comp").alias("major"))
    minor = rows.join(lists, "h").where("comp != major").drop("major")
    other = rows.select("h", *(F.col(c).alias(f"{c}2") for c in ("sid", "comp", "n", "i", "index")))
    larger = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("sid") > F.col("sid2")))
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("n2")) - 1e-9)
    fits = (F.col("comp") != F.col("comp2")) & F.when(larger, F.col("index2")).otherwise(F.col("index")) & (F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= least)
    pairs = minor.join(other, "h").where(fits).select(F.least("sid", "sid2").alias("u"), F.greatest("sid", "sid2").alias("v")).distinct()
    side = lambda c: whole.select(F.col("sid").alias(c), F.col("shingles").alias(f"set_{c}"))
    return scratch.written(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_common, "u long, v long"), "links-prefixes")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fits = []
        for a, b in zip(batch.column("set_u"), batch.column("set_v")):
            a, b = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            fits.append(both >= SIMILARITY * (len(a) + len(b) - both))
        kept = batch.filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], names=["u", "v"])


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    pairs = scratch.written(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).distinct()
    texts = scratch.written(texts(asked), "texts")
    side = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))
    found = scratch.written(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_similar, "u long, v long"), "links")
    scratch.free("texts")
    return found
