"""Exact quantiles of continuous values by distributed selection: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch, written

#: Distinct values of one part that are ranked in one task; larger parts are parted again.
LIMIT = 1 << 20
#: Cells into which a part is cut in a round, and the relative error of the sketch that places the cuts.
CELLS, ERROR = 64, 1 / 1000


def _meet(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a and b where `names` are alike, nulls too; of these columns a's stay."""
    if not names:
        return a.crossJoin(F.broadcast(b))  # one row
    other = b.select(*(F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return a.join(other, on, how).drop(*(f"_{c}" for c in names))


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, limit: int = LIMIT, cells: int = CELLS) -> DataFrame:
    """by, n, q: for every group the number of values and their quantiles at `points` (array, linear between the two nearest ranks).

    Nulls and NaN count nowhere; groups without any other value, and an empty table, have no row; null keys are a group like any other.

    Each rank is looked for by narrowing: a mergeable sketch cuts a group into cells, one pass counts each cell's values, and only the cells
    that hold a wanted rank are kept, summed by value, until such a part has at most `limit` distinct values and is ranked. The counts are
    exact, so that the sketch's error only decides how many values are left, never which is taken. A hot group's rows are cut and counted where they
    are; what is shuffled are its counts and the values of the wanted cells.
    """
    by = by or []
    g = [f"g{i}" for i in range(len(by))]
    with Scratch(df.sparkSession) as scratch:
        slim = df.select(*(df[c].alias(n) for n, c in zip(g, by)), df[value].cast("double").alias("x")).where("x is not null and not isnan(x)")
        rows = scratch.written(slim.select(*g, F.lit("").alias("part"), F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")).alias("x"), F.lit(1).cast("long").alias("w")), "values")
        key = [*g, "part"]
        sizes = scratch.written(rows.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
        place = lambda p: (F.col("n") - 1) * F.lit(float(p))
        ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in points))))
        wanted = scratch.written(sizes.select(*key, F.explode(ranks).alias("rank")).withColumn("k", F.col("rank")), "wanted")
        most, turn = sizes.agg(F.max("n")).first()[0] or 0, 0
        while most > limit:
            shares = F.array(*(F.lit((i + 1) / cells) for i in range(cells - 1)))
            cuts = rows.groupBy(*key).agg(F.array_distinct(F.percentile_approx("x", shares, int(1 / ERROR))).alias("cuts"))
            cut = _meet(rows, cuts, key).select(*key, "x", "w", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("cell"))
            counts = cut.groupBy(*key, "cell").agg(F.sum("w").alias("m"))
            upto = F.sum("m").over(Window.partitionBy(*key).orderBy("cell"))  # of `cells` rows at most
            counts = scratch.written(counts.withColumn("before", upto - F.col("m")), f"counts{turn}")
            inside = (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("m"))
            held = _meet(wanted, counts, key).where(inside)
            further = F.concat_ws(".", "part", F.col("cell").cast("string"))
            wanted = scratch.written(held.select(*key, "cell", "rank", (F.col("k") - F.col("before")).alias("k")), f"wanted{turn}")
            kept = wanted.select(*key, "cell").distinct()
            rows = _meet(cut, kept, [*key, "cell"], "left_semi").groupBy(*key, "cell", "x").agg(F.sum("w").alias("w"))
            rows = scratch.written(rows.select(*g, further.alias("part"), "x", "w"), f"rows{turn}")
            wanted = wanted.select(*g, further.alias("part"), "rank", "k")
            most, turn = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0], turn + 1
        upto = F.sum("w").over(Window.partitionBy(*key).orderBy("x"))
        ranked = rows.groupBy(*key, "x").agg(F.sum("w").alias("w")).withColumn("upto", upto)
        found = _meet(wanted, ranked, key).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("w")))
        found = found.groupBy(*g).agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("at"))  # two ranks a point at most
        sizes = sizes.drop("part")

        def point(p: float):
            h = place(p)
            low, high = F.col("at")[F.floor(h)], F.col("at")[F.ceil(h)]
            return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

        told = _meet(sizes, found, g).select(*(F.col(n).alias(c) for n, c in zip(g, by)), "n", F.array(*map(point, points)).alias("q"))
        return written(told, "quantiles")
