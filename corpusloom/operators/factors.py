"""Matrix statistics of two aligned sets of vectors from triangular factors, which a tree of QR steps reduces: products of the
vectors, whose condition is the square of theirs, are never formed over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

#: Groups of each level of the tree: one joins some 16 factors of the level before (65,536 partitions) or fewer.
LEVELS = (4096, 256, 16, 1)
SCHEMA = "by string, x_dims int, y_dims int, n long, r binary, place long"


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


class Factors:
    """n, the means, and R of [x, y] as it is and centred: with Q of no account, R' R are the products of the columns."""

    def __init__(self, n: int, r: np.ndarray, x_dims: int):
        self.n, self.dims = n, x_dims
        mean = r[0, 1:] / r[0, 0]
        self.mx, self.my = mean[:x_dims], mean[x_dims:]
        self.whole, centred = r[:, 1:], r[1:, 1:].copy()  # the first column of R is that of the ones: what is below it is orthogonal to them
        constant = np.linalg.norm(centred, axis=0) <= 64 * np.finfo("f8").eps * np.linalg.norm(self.whole, axis=0)
        centred[:, constant] = 0  # nothing but rounding
        self.x, self.y = centred[:, :x_dims], centred[:, x_dims:]

    def cka(self) -> float:
        low = np.linalg.norm(self.x.T @ self.x) * np.linalg.norm(self.y.T @ self.y)
        return float(np.linalg.norm(self.x.T @ self.y) ** 2 / low) if low else 0.0

    def svcca(self, keep: float = 0.99, ridge: float = 1e-6) -> float:
        """Mean canonical correlation of the principal directions (of the vectors as they are) that hold `keep` of the sum of squares, whitened by
        inverse Cholesky factors on both sides; where a covariance has none, by pseudo-inverses. 0 for fewer than two rows."""
        if self.n <= 1:
            return 0.0

        def directions(r: np.ndarray) -> np.ndarray:
            _, s, vt = np.linalg.svd(r, full_matrices=False)
            held = np.cumsum(s * s) / max((s * s).sum(), 1e-300)
            k = int(np.argmax(held >= keep)) + 1
            return vt[: max(1, min(k, len(s), self.n - 1))].T

        ux, uy = directions(self.whole[:, : self.dims]), directions(self.whole[:, self.dims :])
        k = min(ux.shape[1], uy.shape[1], self.n - 1)
        x, y = self.x @ ux[:, :k], self.y @ uy[:, :k]
        xx, yy, xy = (p.T @ q / (self.n - 1) for p, q in ((x, x), (y, y), (x, y)))
        xx, yy = xx + ridge * np.eye(k), yy + ridge * np.eye(k)
        try:
            cross = np.linalg.inv(np.linalg.cholesky(xx)) @ xy @ np.linalg.inv(np.linalg.cholesky(yy))
            return float(np.clip(np.linalg.svd(cross, compute_uv=False), 0, 1).mean())
        except np.linalg.LinAlgError:
            both = np.linalg.pinv(xx) @ xy @ np.linalg.pinv(yy) @ xy.T
            found = np.sqrt(np.maximum(np.linalg.eigvals(both).real, 0))
            found = found[found > 1e-10]
            return float(found.mean()) if len(found) else 0.0

    def procrustes(self) -> dict[str, float]:
        """Scale and normalised error of the best rotation of x onto y."""
        s = np.linalg.svd(self.x.T @ self.y, compute_uv=False).sum()
        x, y = np.linalg.norm(self.x) ** 2, np.linalg.norm(self.y) ** 2
        return {"scale": float(s / x) if x else 0.0, "error": float(1 - s * s / (x * y)) if x * y else 0.0}

    def pca(self, k: int = 2) -> dict[str, np.ndarray]:
        """Of both sets together: explained shares, loadings, and the shift between the sets' means along them."""
        _, s, vt = np.linalg.svd(np.vstack((self.x, self.y, np.sqrt(self.n / 2) * (self.mx - self.my)[None, :])), full_matrices=False)
        u = vt.T
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1)  # the largest loading of each is positive
        k = min(k, u.shape[1])
        top = [np.argsort(-np.abs(u[:, i]), kind="stable")[:10] for i in range(k)]
        shared = sorted(set(top[0][:5].tolist()) & set(top[1][:5].tolist())) if len(top) > 1 else []
        return {"explained": (s * s)[:k] / max((s * s).sum(), 1e-300), "loadings": u[:, :k], "mean": (self.mx + self.my) / 2, "shift": (self.my - self.mx) @ u[:, :k], "top_dims": top[0], "top_dims_each": top, "shared_top": shared}


def factors_by(df: DataFrame, a: str, b: str, by: str | None = None) -> dict[str | None, Factors]:
    """Factors of the vectors a and b for each value of `by` (none: of all rows, under None), in one pass.

    A task keeps one factor a value, of a size that follows the dimensions; a tree of at most four small shuffles joins them. Rows without either vector
    count nowhere; vectors of one side must have one length. What comes back is one factor a value."""
    key = F.col(by).cast("string") if by else F.lit(None).cast("string")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")[:-1]]

    def table(by, x_dims, y_dims, n, r) -> dict:
        return {"by": pa.array([by], pa.string()), "x_dims": pa.array([x_dims], pa.int32()), "y_dims": pa.array([y_dims], pa.int32()), "n": pa.array([n], pa.int64()), "r": pa.array([np.ascontiguousarray(r).astype("<f8").tobytes()], pa.binary())}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            values = np.array(batch.column("by").to_pylist(), object)
            for value in dict.fromkeys(values.tolist()):
                rows = batch.filter(pa.array([z == value for z in values]))
                x, y = (np.array(rows.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(rows.num_rows, -1) for c in ("x", "y"))
                new = np.hstack((np.ones((len(x), 1)), x, y))
                n, r, *_ = held.get(value, (0, new[:0]))
                held[value] = n + len(x), _triangle(np.vstack((r, new))), x.shape[1], y.shape[1]
        for value, (n, r, x_dims, y_dims) in held.items():
            yield pa.RecordBatch.from_arrays([*table(value, x_dims, y_dims, n, r).values()], names=names)

    def join(t: pa.Table) -> pa.Table:
        wide = 1 + t["x_dims"][0].as_py() + t["y_dims"][0].as_py()
        r = np.zeros((0, wide))
        for raw in t["r"]:
            r = _triangle(np.vstack((r, np.frombuffer(raw.as_py(), "<f8").reshape(-1, wide))))
        return pa.table(table(t["by"][0].as_py(), t["x_dims"][0].as_py(), t["y_dims"][0].as_py(), sum(t["n"].to_pylist()), r) | {"place": t["place"][:1]})

    rows = df.select(key.alias("by"), v.doubles(F.col(a)).alias("x"), v.doubles(F.col(b)).alias("y")).where("x is not null and y is not null")
    parts = rows.mapInArrow(part, SCHEMA.rsplit(", ", 1)[0]).withColumn("place", F.spark_partition_id().cast("long"))
    for groups in LEVELS:
        parts = parts.withColumn("place", F.col("place") % groups).groupBy("by", "place").applyInArrow(join, SCHEMA)
    told = {}
    for row in parts.collect():
        wide = 1 + row["x_dims"] + row["y_dims"]
        told[row["by"]] = Factors(row["n"], np.frombuffer(bytes(row["r"]), "<f8").reshape(-1, wide), row["x_dims"])
    return told


def factors(df: DataFrame, a: str, b: str) -> Factors:
    told = factors_by(df, a, b)
    if not told:
        raise ValueError("no rows")
    return told[None]
