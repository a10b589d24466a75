"""Exact top-k inner products by best-first search in M-trees, one tree for each block of vectors."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cells import deal, distances, matrix
from .common import Scratch, written
from .embeddings import valid

SCALE, TOP, EVERY, PAGE, TREE, QUERIES = 256, 5, 50, 96, 4096, 512
#: Room for rounding in the bounds, relative to the lengths of the vectors.
ROOM = 1e-9


class MTree:
    """Paged metric tree over the Euclidean distance.

    Each page holds its entries' routing vectors, their covering radii (0 in a leaf), their distances to the page's own
    routing vector, and the largest norm below each. Bulk loading deals a page's vectors to the nearest of
    routing vectors spread out by farthest-first choice, until a page holds them.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE):
        self.x, self.ids, self.page = vectors, ids, page
        self.norm = np.linalg.norm(vectors, axis=1)
        self.pages: list[tuple] = []
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else -1

    def _load(self, rows: np.ndarray, router: int | None) -> int:
        to = lambda r: np.linalg.norm(self.x[rows] - self.x[r], axis=1)
        at = len(self.pages)
        self.pages.append(())
        if len(rows) <= self.page:
            parent = to(router) if router is not None else np.zeros(len(rows))
            self.pages[at] = (True, rows, np.zeros(len(rows)), parent, self.norm[rows], None)
            return at
        ways = min(self.page, -(-len(rows) // (self.page // 2)))
        chosen, best, nearest = [], np.full(len(rows), np.inf), np.zeros(len(rows), "i8")
        pick = int(np.argmax(to(int(rows[0]))))
        for k in range(ways):
            d = to(int(rows[pick]))
            closer = d < best
            best[closer], nearest[closer] = d[closer], k
            chosen.append(int(rows[pick]))
            pick = int(np.argmax(best))
            if best[pick] == 0:
                break
        if len(chosen) == 1:  # equal vectors: any split will do, the radius is 0
            nearest = np.arange(len(rows)) // self.page
            chosen = [int(rows[nearest == k][0]) for k in range(int(nearest.max()) + 1)]
        kept = [k for k in range(len(chosen)) if (nearest == k).any()]
        routers = np.array([chosen[k] for k in kept])
        radius = np.array([best[nearest == k].max() if len(chosen) > 1 else 0.0 for k in kept])
        parent = np.linalg.norm(self.x[routers] - self.x[router], axis=1) if router is not None else np.zeros(len(kept))
        most = np.array([self.norm[rows[nearest == k]].max() for k in kept])
        below = [self._load(rows[nearest == k], chosen[k]) for k in kept]
        self.pages[at] = (False, routers, radius, parent, most, below)
        return at

    def search(self, q: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) by score, then by smaller id; all but the row with the id `own`."""
        if self.root < 0 or k < 1:
            return []
        qn = float(np.linalg.norm(q))
        room = ROOM * (qn + float(self.norm.max(initial=0)) + 1) ** 2
        found: list[tuple[int, int]] = []  # a heap of (score, -id)
        queue: list[tuple[float, int, float | None]] = [(-np.inf, self.root, None)]
        while queue:
            bound, at, to_router = heapq.heappop(queue)
            least = found[0][0] if len(found) == k else -np.inf
            if -bound < least:
                break  # no page left can hold a better one
            leaf, rows, radius, parent, most, below = self.pages[at]
            if to_router is None:
                go = np.arange(len(rows))
            else:  # without any distance: |d(q, router) - d(entry, router)| - radius is the least distance to what is below
                gap = np.maximum(0.0, np.abs(to_router - parent) - radius)
                go = np.nonzero((qn * qn + most * most - gap * gap) / 2 + room >= least)[0]
            if not len(go):
                continue
            rows = rows[go]
            dots = self.x[rows] @ q
            if leaf:
                for j in np.nonzero(dots >= least)[0].tolist():
                    entry = (int(dots[j]), -int(self.ids[rows[j]]))
                    if -entry[1] == own:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                continue
            distance = np.sqrt(np.maximum(0.0, qn * qn + self.norm[rows] ** 2 - 2 * dots))
            upper = np.minimum(dots + qn * radius[go], (qn * qn + most[go] ** 2 - np.maximum(0.0, distance - radius[go]) ** 2) / 2) + room
            for j in np.nonzero(upper >= least)[0].tolist():
                heapq.heappush(queue, (-float(upper[j]), below[int(go[j])], float(distance[j])))
        return sorted(((s, -i) for s, i in found), key=lambda e: (-e[0], e[1]))


def _bytes(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _tree_bytes(tree: MTree) -> bytes:
    """The pages as flat arrays: entries of all pages in a row, with where each page starts."""
    pages = tree.pages
    cat = lambda k, kind: np.concatenate([np.asarray(p[k], kind) for p in pages]) if pages else np.zeros(0, kind)
    below = np.concatenate([np.asarray(p[5] if p[5] is not None else [-1] * len(p[1]), "i8") for p in pages]) if pages else np.zeros(0, "i8")
    return _bytes(x=tree.x, ids=tree.ids, leaf=np.array([p[0] for p in pages], bool), start=np.cumsum([0, *(len(p[1]) for p in pages)]), rows=cat(1, "i8"), radius=cat(2, "f8"), parent=cat(3, "f8"), most=cat(4, "f8"), below=below)


def _tree_of(raw: bytes) -> MTree:
    z = np.load(io.BytesIO(raw))
    tree = MTree.__new__(MTree)
    tree.x, tree.ids, tree.page, tree.root = z["x"], z["ids"], PAGE, 0 if len(z["leaf"]) else -1
    tree.norm = np.linalg.norm(tree.x, axis=1)
    start, (rows, radius, parent, most, below) = z["start"], (z[k] for k in ("rows", "radius", "parent", "most", "below"))
    tree.pages = [(bool(leaf), rows[a:b], radius[a:b], parent[a:b], most[a:b], below[a:b].tolist()) for leaf, a, b in zip(z["leaf"], start, start[1:])]
    return tree


def upper_bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What the inner product of each row with any vector of each cell is at most: by the pivot's product and the radius, and by the
    least distance to the cell and the largest length in it."""
    length, dots = np.linalg.norm(x, axis=1)[:, None], x @ pivots.T
    far = np.sqrt(np.maximum(0, length**2 + (pivots**2).sum(axis=1)[None, :] - 2 * dots))
    room = ROOM * (length + most[None, :] + np.linalg.norm(pivots, axis=1)[None, :] + 1) ** 2
    least = np.maximum(0, far - radius[None, :] - np.sqrt(room))
    return np.minimum(dots + length * radius[None, :], (length**2 + most[None, :] ** 2 - least**2) / 2) + room


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = TOP, scale: int = SCALE, tree: int = TREE, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k best others.

    Components become floor(scale * x). Scores are exact while they stay under 2**53. Null vectors and such with
    null or non-finite components take no part, nor do null ids; vectors of different lengths aren't compared;
    rows that share a query's id are its own; repeated ids of others are candidates each. An empty table, or
    one without queries, gives no rows. Vectors are dealt to the nearest of a bounded number of pivots, in trees of about `tree`. A query
    first searches one tree of the cell that may hold the largest score; its k-th score there leaves out all cells that can't reach
    it, and only trees of the others are searched, by bundles of about `queries`, with k rows a query and tree.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("key"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("key").isNotNull() & valid(F.col("v")) & (F.size("v") > 0))
    with Scratch(spark) as scratch:
        rows = scratch.written(rows.select("key", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")), "integers")
        dealt, cells = deal(rows, tree, lambda x: x, distances, lambda d: scratch.written(d, "dealt"))
        shared = spark.sparkContext.broadcast(cells)

        def plant(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            return pa.table({"t": pa.array([table["tile"][0].as_py()], pa.int64()), "tree": pa.array([_tree_bytes(MTree(matrix(table["v"]), table["key"].to_numpy()))], pa.binary())})

        planted = scratch.written(dealt.groupBy("tile").applyInArrow(plant, "t long, tree binary"), "trees")

        def targets(first: bool):
            """Rows (key, v, t): a query and a tree that it searches, the first one or all others that may hold a score as good as `least`."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    dims, asked = batch.column("dim").to_numpy(), ([], [])
                    for dim in np.unique(dims):
                        at = np.nonzero(dims == dim)[0]
                        pivots, tiles, start, radius, most = shared.value.of(int(dim))
                        bound = np.where(tiles[None, :] > 0, upper_bounds(matrix(batch.column("v").take(pa.array(at))), pivots, radius, most), -np.inf)
                        if first:
                            asked[0].extend(at)
                            asked[1].extend(start[bound.argmax(axis=1)])
                            continue
                        least, seen = batch.column("least").to_numpy()[at], batch.column("t").to_numpy()[at]
                        for i, row, low, t in zip(at, bound, least, seen):
                            reached = np.concatenate([np.arange(start[c], start[c] + tiles[c]) for c in np.nonzero((row >= low) & (tiles > 0))[0]] or [np.zeros(0, "i8")])
                            reached = reached[reached != t]
                            asked[0].extend([i] * len(reached))
                            asked[1].extend(reached)
                    take = pa.array(np.array(asked[0], "i8"))
                    for a in range(0, len(take), 4096):  # copies of the queries in small batches
                        some = take[a : a + 4096]
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(some), batch.column("v").take(some), pa.array(np.array(asked[1][a : a + 4096], "i8"))], names=["key", "v", "t"])

            return run

        def bundle(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            return pa.table({"t": pa.array([table["t"][0].as_py()], pa.int64()), "asked": pa.array([_bytes(x=matrix(table["v"]), ids=table["key"].to_numpy())], pa.binary())})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw, asks in zip(batch.column("tree"), batch.column("asked")):
                    grown, z = _tree_of(raw.as_py()), np.load(io.BytesIO(asks.as_py()))
                    out = [(int(q), i, s) for q, x in zip(z["ids"], z["x"]) for s, i in grown.search(x, k, int(q))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [(), (), ()])], names=["query_id", "vec_id", "score"])

        def searched(asked: DataFrame, name: str) -> DataFrame:
            """Each tree meets the queries that search it, in bundles; a tree's queries are dealt out by a hash."""
            asked = scratch.written(asked, f"{name}-asked")
            sizes = asked.groupBy("t").agg(F.ceil(F.count("*") / queries).alias("sets"))
            bundles = asked.join(sizes, "t").groupBy("t", F.pmod(F.xxhash64("key"), F.col("sets")).alias("s")).applyInArrow(bundle, "t long, asked binary")
            bundles = scratch.written(bundles, f"{name}-bundles")
            n = bundles.count()
            pairs = planted.join(bundles.hint("merge"), "t").repartition(max(1, n), F.xxhash64("asked"))
            return scratch.written(pairs.select("tree", "asked").mapInArrow(search, "query_id long, vec_id long, score long"), name)

        asked = dealt.where(F.col("key") % every == 0).select("key", "dim", "v")
        begun = scratch.written(asked.mapInArrow(targets(True), "key long, v array<double>, t long"), "first-trees").distinct()
        first = searched(begun, "first")
        least = first.groupBy(F.col("query_id").alias("q")).agg(F.min("score").alias("low"), F.count("*").alias("n"))
        more = begun.join(least, F.col("key") == F.col("q"), "left").select("key", "v", F.size("v").alias("dim"), "t", F.when(F.col("n") >= k, F.col("low")).cast("double").alias("least"))
        more = more.withColumn("least", F.coalesce("least", F.lit(float("-inf")))).mapInArrow(targets(False), "key long, v array<double>, t long")
        best = first.unionByName(searched(more, "others"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
