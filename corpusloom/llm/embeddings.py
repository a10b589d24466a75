"""Embedding near-duplicates: tiles of int8 products with proven error bounds; doubtful pairs again in double precision; cells too far apart never meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import ROOM, angles, deal, matrix, scaled, unit
from .common import Scratch, written
from ..operators.components import components

COSINE, BLOCK, STRIP = 0.95, 4096, 512


def valid(column):
    """Not null, no null or non-finite component."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, the scale of each row, and the length of what each row loses by them."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype("i1")
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, lost


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float = COSINE, same: bool = False):
    """(rows, columns) of pairs with cosine >= threshold; same: x is y, only rows < columns.

    |u.v - su.sv.qu.qv| <= (1 + lost_u) lost_v + lost_u for unit vectors u and v; only pairs that may reach
    the threshold within this bound are computed in double precision. Products of codes are exact in
    single precision for up to 1024 components at a time.
    """
    x, y = scaled(x), scaled(y)
    xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (xq, xs, xl), (yq, ys, yl) = quantise(x / xn[:, None]), quantise(y / yn[:, None])
    yf, dim, rows, columns = yq.astype("f4"), x.shape[1], [], []
    slack = 1e-5  # of the single-precision products with the scales
    for a in range(0, len(x), STRIP):
        xf = xq[a : a + STRIP].astype("f4")
        got = sum((xf[:, d : d + 1024] @ yf[:, d : d + 1024].T for d in range(0, dim, 1024)), np.float32(0))
        got *= ys.astype("f4")
        # u.v can reach the threshold only if the product does so with the largest loss of this row and of the other side
        most = (1 + xl[a : a + STRIP]) * yl.max(initial=0) + xl[a : a + STRIP]
        i, j = np.nonzero(got >= ((threshold - most - slack) / xs[a : a + STRIP])[:, None].astype("f4"))
        if same:
            i, j = i[i + a < j], j[i + a < j]
        for b in range(0, len(i), 1 << 16):
            p, q = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
            may = got[p - a, q] * xs[p] + (1 + xl[p]) * yl[q] + xl[p] + slack >= threshold
            p, q = p[may], q[may]
            true = np.einsum("ij,ij->i", x[p], y[q]) / (xn[p] * yn[q]) >= threshold
            rows.append(p[true])
            columns.append(q[true])
    cat = lambda z: np.concatenate(z) if z else np.zeros(0, "i8")
    return cat(rows), cat(columns)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = np.minimum(root, root[root])
        if (root == old).all():
            return root


def partners(x: np.ndarray, own: np.ndarray, near: np.ndarray, cells: tuple, angle: float) -> list[np.ndarray]:
    """For each row the tiles that may hold vectors within the angle: of cells whose ball reaches so far, and whose vectors, being nearer to
    that cell's pivot than to this one's, may be so near."""
    pivots, tiles, first, radius, _ = cells
    far = angles(x, pivots)
    may = (far <= radius[None, :] + angle + ROOM) & (far <= near[:, None] + 2 * angle + ROOM) & (tiles > 0)[None, :]
    may[np.arange(len(x)), own] = True
    every = [np.arange(f, f + n) for f, n in zip(first, tiles)]
    return [np.concatenate([every[c] for c in np.nonzero(row)[0]]) for row in may]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of the table.

    Equal vectors are collapsed first and counted by their number. The distinct ones are dealt to the nearest of a bounded number of pivots,
    in tiles of about `block`; a vector meets a tile only if the triangle inequality of angles lets a partner be in its cell.
    Each pair of tiles gives the number of links of each vector and a spanning forest of its links, never the links
    themselves. Null, zero, non-finite vectors and those with null components link with nothing, nor do vectors of different lengths; such
    rows have no links and are their own component. A null vec_id stays null and links with nothing; repeated ids are vectors of their own.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = rows.where(valid(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    groups = written(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vectors")
    with Scratch(vectors.sparkSession) as scratch:
        keyed = groups.select(F.col("rep").alias("key"), F.size("v").alias("dim"), "v", "m")
        dealt, cells = deal(keyed, block, unit, angles, lambda d: scratch.written(d, "dealt"))
        shared, angle = vectors.sparkSession.sparkContext.broadcast(cells), float(np.arccos(threshold))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    found = partners(unit(matrix(part.column("v"))), part.column("cell").to_numpy(), part.column("near").to_numpy(), shared.value.of(int(dim)), angle)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "m", "dim", "v", "tile")), pa.array(found, pa.list_(pa.int64()))], names=["rep", "m", "dim", "v", "b", "others"])

        near = dealt.mapInArrow(reach, "rep long, m long, dim int, v array<double>, b long, others array<long>").withColumn("o", F.explode("others"))
        tiled = near.select("rep", "m", "v", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "dim")

        def tile(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            b, lo, hi = table["b"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
            v, m, rep = matrix(table["v"]), table["m"].to_numpy(), table["rep"].to_numpy()
            left = np.nonzero(b == lo)[0]
            right = left if lo == hi else np.nonzero(b == hi)[0]
            if not len(left) or not len(right):
                return pa.table({"node": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            i, j = tile_links(v[left], v[right], threshold, lo == hi)
            i, j = left[i], right[j]
            count = np.bincount(i, m[j], len(b)) + np.bincount(j, m[i], len(b))
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), "i8")
            place[order] = np.arange(len(rep))
            root = rep[order][forest(len(rep), place[i], place[j])[place]]
            hit = np.nonzero(count)[0]
            return pa.table({"node": rep[hit], "root": root[hit], "n": count[hit].astype("i8")})

        found = scratch.written(tiled.groupBy("lo", "hi", "dim").applyInArrow(tile, "node long, root long, n long"), "tiles")
        count = written(found.groupBy("node").agg(F.sum("n").alias("n")), "links")
        root = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    told = groups.join(count, groups.rep == count.node, "left").drop("node").join(root, F.col("rep") == root.node, "left")
    told = told.select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(told, (rows.v == told.w) & rows.vec_id.isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
