"""Vectors dealt to the nearest of a bounded number of pivots, so that whole cells can be left out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pivots of one length of vectors at most, whatever the table's size: what is broadcast is this many vectors.
PIVOTS = 1024
#: Room for rounding in distances and angles.
ROOM = 1e-6


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square over- or underflows."""
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: exact, and of the same directions."""
    top = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, -top[:, None])


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between rows of length 1, to full precision for small ones too."""
    return 2 * np.arcsin(np.minimum(1, distances(x, pivots) / 2))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean ones, each by the differences of components."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in one dimension more, which only rows of zeros use: they are at a right angle to all others."""
    x = scaled(x)
    length = np.linalg.norm(x, axis=1)
    return np.hstack((x / np.where(length > 0, length, 1)[:, None], (length == 0).astype("f8")[:, None]))


class Cells:
    """Pivots by length of vectors, and of each cell its number of tiles, radius, largest length and number of vectors."""

    def __init__(self, pivots: dict[int, np.ndarray], told: dict[tuple[int, int], tuple[int, float, float]], first: dict[tuple[int, int], int], count: dict[tuple[int, int], int]):
        self.pivots, self.told, self.first, self.count = pivots, told, first, count

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pivots, tiles, first tile, radius, largest length) of the cells of one length; cells without vectors have no tiles."""
        p = self.pivots[dim]
        rows = [(*self.told.get((dim, c), (0, 0.0, 0.0)), self.first.get((dim, c), 0)) for c in range(len(p))]
        n, radius, most, first = (np.array(x) for x in zip(*rows))
        return p, n, first, radius, most

    def tiles(self, dim: int, cells: np.ndarray) -> np.ndarray:
        """The tiles of the cells of one length."""
        found = [np.arange(f, f + n) for f, n in ((self.first[dim, int(c)], self.told[dim, int(c)][0]) for c in cells if (dim, int(c)) in self.told)]
        return np.concatenate(found) if found else np.zeros(0, "i8")

    def within(self, dim: int, far: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells (rows of `far`: distances to all pivots) may hold vectors within the bound of each row: those whose ball reaches so far, and
        whose vectors, being nearer to that cell's pivot than to the row's nearest one, may be so near."""
        _, n, _, radius, _ = self.of(dim)
        near = far.min(axis=1, initial=np.inf)
        return (far <= radius[None, :] + bound[:, None] + ROOM) & (far <= near[:, None] + 2 * bound[:, None] + ROOM) & (n > 0)[None, :]


def deal(vectors: DataFrame, block: int, prepare: Callable[[np.ndarray], np.ndarray], measure: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: Callable[[DataFrame], DataFrame], most: int = PIVOTS, pivots: dict[int, np.ndarray] | None = None) -> tuple[DataFrame, Cells]:
    """vectors (key long, dim int, v array<double>, more) with tile long (of about `block` vectors of one cell) and near double (to its pivot), and
    the cells. Pivots are taken by a hash of the key; a cell of more vectors has several tiles, dealt by that hash; `keep` writes the table. Given pivots (of
    other vectors) are taken as they are, and vectors of lengths without any are left out."""
    number = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()} if pivots is None else {}  # a row for each length
    pivots = {} if pivots is None else pivots
    for dim, n in number.items():
        want = max(1, min(most, -(-n // block)))
        taken = vectors.where(F.col("dim") == dim).select("v", F.xxhash64("key").alias("h")).orderBy("h", "v").limit(want).collect()
        pivots[dim] = prepare(np.array([r["v"] for r in taken], "f8"))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    names = vectors.columns
    schema = StructType(list(vectors.schema.fields)).add("cell", "integer").add("near", "double").add("length", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in shared.value:
                    continue
                part = batch.filter(pa.array(dims == dim))
                x = prepare(matrix(part.column("v")))
                far = measure(x, shared.value[int(dim)])
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype("i4")), pa.array(far[np.arange(len(far)), cell]), pa.array(np.linalg.norm(x, axis=1))], names=[*names, "cell", "near", "length"])

    dealt = keep(vectors.mapInArrow(run, schema))
    told, first, count, tiles = {}, {}, {}, 0
    for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("length").alias("length")).orderBy("dim", "cell").collect():  # a row a cell
        told[r["dim"], r["cell"]] = (-(-r["n"] // block), r["near"], r["length"])
        first[r["dim"], r["cell"]], count[r["dim"], r["cell"]] = tiles, r["n"]
        tiles += told[r["dim"], r["cell"]][0]
    rows = [(d, c, first[d, c], told[d, c][0]) for d, c in told] or [(-1, -1, 0, 1)]
    places = spark.createDataFrame(rows, "dim int, cell int, __first long, __tiles long")
    placed = dealt.join(F.broadcast(places), ["dim", "cell"]).withColumn("tile", F.col("__first") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("__tiles")))
    return placed.select(*names, "cell", "near", "tile"), Cells(pivots, told, first, count)
