"""The data behind figures, as tables: bins, boxes, heat maps, curves by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confidence import r6
from .quantiles import quantiles


def equal_bins(df: DataFrame, value: str, bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """by, bin, low, high, n: bins of equal width from the least to the largest value, empty ones included.

    Bins are half-open, the last one is closed; values that are all alike get a range of 1 around them; nulls and NaN count nowhere.
    One pass for the range, one for the counts, which are summed before the shuffle.
    """
    by = by or []
    rows = df.select(*(df[c].alias(f"__b{i}") for i, c in enumerate(by)), df[value].cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    keys = [f"__b{i}" for i in range(len(by))] + ["__one"]
    rows = rows.withColumn("__one", F.lit(1))
    ends = rows.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    flat = F.col("__lo") == F.col("__hi")
    ends = ends.select(*(F.col(k).alias(f"{k}e") for k in keys), F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"), F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"))
    alike = lambda x, y: [F.col(f"{k}{x}").eqNullSafe(F.col(f"{k}{y}")) for k in keys]
    place = F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)
    counts = rows.join(ends, alike("", "e")).groupBy(*(F.col(k).alias(f"{k}c") for k in keys), F.least(F.lit(bins - 1), place).cast("int").alias("__bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda i: r6(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * i / bins)
    out = every.join(counts, [*alike("e", "c"), F.col("bin") == F.col("__bin")], "left")
    return out.select(*(F.col(f"{k}e").alias(c) for k, c in zip(keys, by)), "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, q1, median, q3, and the whiskers: the values furthest out within 1.5 ranges between the quartiles; values beyond them."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], by).withColumnRenamed("q", "__q")
    near = 1.5 * (F.col("__q")[2] - F.col("__q")[0])
    inside = F.col(value).between(F.col("__q")[0] - near, F.col("__q")[2] + near)
    keyed = df.join(q.select(*(q[c].alias(f"__{c}") for c in by), "__q"), [df[c].eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    return keyed.groupBy(*by).agg(
        F.count(value).alias("n"), *(r6(F.first("__q")[i]).alias(c) for i, c in enumerate(("q1", "median", "q3"))),
        r6(F.min(F.when(inside, F.col(value)))).alias("low"), r6(F.max(F.when(inside, F.col(value)))).alias("high"), F.count_if(~inside).alias("outside"),
    )


def heat(df: DataFrame, row: str | Column, column: str | Column, value: str) -> DataFrame:
    """row, column, value: the cells of a heat map in long form, means where a cell has more rows."""
    cell = [F.col(c) if isinstance(c, str) else c for c in (row, column)]
    return df.groupBy(cell[0].alias("row"), cell[1].alias("column")).agg(r6(F.avg(value)).alias("value"))


def curve(df: DataFrame, position: str, value: str, by: list[str]) -> DataFrame:
    """by, position, mean, std, n: a line with its band."""
    return df.groupBy(*by, position).agg(r6(F.avg(value)).alias("mean"), r6(F.stddev_pop(value)).alias("std"), F.count(value).alias("n"))
