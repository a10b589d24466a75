"""Blocks of vectors as rows, which meet by a cartesian product: all pairs without a copy of the vectors for each."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import matrix

#: Bytes of vectors in a part of the right side, which a task holds, and of the left, which it goes through.
RIGHT, LEFT = 64 << 20, 8 << 20
#: Pairs of blocks that go to Python at once.
ROWS = 8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_rows(spark: SparkSession, most: int = ROWS) -> Iterator[None]:
    """What is written in here hands so many rows to Python at once, as a row is a block of vectors or two."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def packed(dealt: DataFrame, label: str | None = None) -> DataFrame:
    """dealt (tile long, key long, dim int, v array<double>, label string) -> tile, dim, keys, x, width, labels: a row a tile, its vectors as bytes, four
    for a component where these hold all of them exactly, else eight."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = matrix(t["v"])
        with np.errstate(over="ignore"):
            small = x.astype("<f4")
        kept = small if np.array_equal(small, x, equal_nan=True) else x.astype("<f8")
        out = {"tile": t["tile"][:1], "dim": t["dim"][:1], "keys": pa.array([t["key"].to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([kept.tobytes()], pa.binary()), "width": pa.array([kept.itemsize], pa.int32())}
        return pa.table(out | ({"labels": pa.array([t[label].to_pylist()], pa.list_(pa.string()))} if label else {}))

    columns = ["tile", "key", "dim", "v", *([label] if label else [])]
    return dealt.select(*columns).groupBy("tile").applyInArrow(run, "tile long, dim int, keys binary, x binary, width int" + (", labels array<string>" if label else ""))


def block_of(batch: pa.RecordBatch, i: int, side: str = "") -> dict:
    """key, x, and the columns of lists idx, other and sim (where there are any) of a block."""
    key = np.frombuffer(batch.column(f"{side}keys")[i].as_buffer(), "<i8")
    x = np.frombuffer(batch.column(f"{side}x")[i].as_buffer(), f"<f{batch.column(f'{side}width')[i].as_py()}")
    row = {"key": key, "x": x.reshape(len(key), -1).astype("f8")}
    for c in ("idx", "other", "sim"):
        if f"{side}{c}" in batch.schema.names and batch.column(f"{side}{c}")[i].is_valid:
            row[c] = batch.column(f"{side}{c}")[i].values.to_numpy(zero_copy_only=False)
    return row


def crossed(left: DataFrame, right: DataFrame, fits: Column | None = None) -> DataFrame:
    """Each block of the left (columns a_...) with each of the right (b_...) that fits it.

    A task meets a part of the left with a part of the right, block by block, so that a function over its rows can keep what it found for a block of the
    left until its end. Both sides are dealt out once; what is read again grows with the parts, and nothing is written for a pair."""
    bytes_ = F.sum(F.length("x").cast("long")).alias("b")
    n, a = left.agg(F.count("*").alias("n"), bytes_).first()
    b = right.agg(bytes_).first()[0]
    parts = min(n, max(4 * left.sparkSession.sparkContext.defaultParallelism, -(-(a or 0) // LEFT)))
    a = left.repartition(max(1, parts)).select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = right.repartition(max(1, -(-(b or 0) // RIGHT))).select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    return a.join(b.hint("shuffle_replicate_nl"), F.lit(True) if fits is None else fits)
