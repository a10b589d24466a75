"""Attention as rows of arrays (layer, i, heads: array of head and w, the weights of one position over all j).

Measures are worked out in the row that holds the weights; what is shuffled are sums a layer, head or place. Null arrays count as absent heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from .confidence import r6


def blocks(att: DataFrame) -> DataFrame:
    """From long tables (layer, head, i, j, w; j from 0, absent weights 0): one shuffle, for all measures."""
    row = F.sort_array(F.collect_list(F.struct("j", F.col("w").cast("double").alias("w"))))
    row = att.groupBy("layer", "i", "head").agg(row.alias("row"))
    at = lambda r: F.map_from_arrays(F.transform(r, lambda x: x["j"].cast("int")), F.transform(r, lambda x: x["w"]))
    dense = row.select("layer", "i", "head", F.transform(F.sequence(F.lit(0), F.array_max(F.transform("row", lambda x: x["j"].cast("int")))), lambda j: F.coalesce(F.try_element_at(at(F.col("row")), j), F.lit(0.0))).alias("w"))
    return dense.groupBy("layer", "i").agg(F.sort_array(F.collect_list(F.struct("head", "w"))).alias("heads"))


def long(b: DataFrame) -> DataFrame:
    """layer, head, i, j, w: a row a weight."""
    one = b.select("layer", "i", F.inline("heads"))
    return one.select("layer", "head", "i", F.posexplode("w").alias("j", "w")).withColumn("j", F.col("j").cast("long"))


def _each(b: DataFrame, **measures) -> DataFrame:
    """layer, head and one number of each measure (of w and i) for each row and head; the weights stay where they are."""
    i = F.col("i").cast("int")
    told = F.transform(F.filter("heads", lambda h: h["w"].isNotNull()), lambda h: F.struct(h["head"].alias("head"), *(f(h["w"], i).alias(n) for n, f in measures.items())))
    return b.select("layer", F.inline(told))


def _entropy(w: Column, _=None) -> Column:
    return -v.total(F.transform(w, lambda x: x * F.ln(x + 1e-8)))


def mean(heads: Column) -> Column:
    """The mean over the heads of one row, as long as the longest; a head that is shorter counts for what it has."""
    wide = F.transform(F.filter(heads, lambda h: h["w"].isNotNull()), lambda h: h["w"])
    longest = F.array_max(F.transform(wide, lambda w: F.size(w)))
    part = lambda j: F.filter(F.transform(wide, lambda w: F.get(w, j)), lambda x: x.isNotNull())
    one = lambda j: v.bound(part(j), lambda p: v.total(p) / F.size(p))
    return F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), one)).otherwise(F.array().cast("array<double>"))


def _head_entropy(b: DataFrame) -> DataFrame:
    return _each(b, e=_entropy).groupBy("layer", "head").agg(F.avg("e").alias("entropy"))


def head_entropy(b: DataFrame) -> DataFrame:
    """Mean over rows of -sum w ln(w + 1e-8)."""
    return _head_entropy(b).withColumn("entropy", r6("entropy"))


def layer_entropy(b: DataFrame) -> DataFrame:
    """Of the mean over heads."""
    return b.select("layer", _entropy(mean(F.col("heads"))).alias("e")).groupBy("layer").agg(r6(F.avg("e")).alias("entropy"))


def distance(b: DataFrame) -> DataFrame:
    far = lambda w, i: v.total(F.transform(w, lambda x, j: x * F.abs(j - i)))
    return _each(b, d=far).groupBy("layer", "head").agg(r6(F.avg("d")).alias("distance"))


def self_attention(b: DataFrame) -> DataFrame:
    own = _each(b, w=lambda w, i: F.get(w, i)).where("w is not null")
    return own.groupBy("layer", "head").agg(r6(F.avg("w")).alias("mean"), r6(F.stddev_pop("w")).alias("std"), r6(F.max("w")).alias("max"))


def token_importance(b: DataFrame) -> DataFrame:
    """layer, j, importance (share of all weights that go to j), rank. A row's heads are summed in the row, rows before the shuffle."""
    summed = F.aggregate(F.filter("heads", lambda h: h["w"].isNotNull()), F.array().cast("array<double>"), lambda s, h: F.zip_with(s, v.doubles(h["w"]), lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    s = b.select("layer", F.posexplode(summed).alias("j", "w")).groupBy("layer", F.col("j").cast("long").alias("j")).agg(F.sum("w").alias("s"))
    w = Window.partitionBy("layer")
    return s.withColumns({"importance": r6(F.col("s") / F.sum("s").over(w)), "rank": F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), "j"))}).drop("s")


def flow(b: DataFrame, near: int = 2) -> DataFrame:
    """Shares of weight that go forward, backward and to tokens within `near`."""
    part = lambda keep: lambda w, i: v.total(F.transform(w, lambda x, j: F.when(keep(i, j), x).otherwise(0.0)))
    told = _each(b, forward=part(lambda i, j: j > i), backward=part(lambda i, j: j < i), local=part(lambda i, j: F.abs(j - i) <= near), every=lambda w, i: v.total(v.doubles(w)))
    return told.groupBy("layer").agg(*(r6(F.sum(c) / F.sum("every")).alias(c) for c in ("forward", "backward", "local")))


def align(a: DataFrame, b: DataFrame, pad: bool = False) -> DataFrame:
    """layer, i, x, y: the means over heads of each row, as arrays of one length; shapes that differ are cropped to the common part, or padded by 0."""
    side = lambda t, n: t.select("layer", "i", mean(F.col("heads")).alias(n))
    if pad:
        none = F.array().cast("array<double>")
        j = side(a, "x").join(side(b, "y"), ["layer", "i"], "full_outer").select("layer", "i", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
        both = F.zip_with("x", "y", lambda x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y")))
        wide = j.select("layer", "i", both.alias("z"))
        return wide.select("layer", "i", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    j = side(a, "x").join(side(b, "y"), ["layer", "i"])
    n = F.least(F.size("x"), F.size("y"))
    return j.select("layer", "i", F.slice("x", F.lit(1), n).alias("x"), F.slice("y", F.lit(1), n).alias("y"))


def compare_layers(a: DataFrame, b: DataFrame, pad: bool = False) -> DataFrame:
    """Cosine (0 for zero vectors), MSE and correlation of each common layer, from seven sums a row."""
    d = F.transform(F.zip_with("x", "y", lambda x, y: x - y), lambda z: z * z)
    sums = {"n": F.size("x").cast("double"), "sx": v.total(F.col("x")), "sy": v.total(F.col("y")), "xx": v.dot(F.col("x"), F.col("x")), "yy": v.dot(F.col("y"), F.col("y")), "xy": v.dot(F.col("x"), F.col("y")), "dd": v.total(d)}
    s = align(a, b, pad).select("layer", *(c.alias(n) for n, c in sums.items())).groupBy("layer").agg(*(F.sum(n).alias(n) for n in sums))
    c = {n: F.col(n) for n in sums}
    over = c["n"] * c["xy"] - c["sx"] * c["sy"]
    under = F.sqrt(F.greatest(c["n"] * c["xx"] - c["sx"] * c["sx"], F.lit(0.0))) * F.sqrt(F.greatest(c["n"] * c["yy"] - c["sy"] * c["sy"], F.lit(0.0)))
    some = lambda x: r6(F.coalesce(x, F.lit(0.0)))
    return s.select("layer", some(c["xy"] / F.nullif(F.sqrt(c["xx"]) * F.sqrt(c["yy"]), F.lit(0.0))).alias("cosine"), r6(c["dd"] / F.nullif(c["n"], F.lit(0.0))).alias("mse"), some(over / F.nullif(under, F.lit(0.0))).alias("correlation"))


def compare_heads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entropies of the heads of two models by place, as far as both have heads, for each common layer."""
    place = F.row_number().over(Window.partitionBy("layer").orderBy("head"))
    side = lambda t, n: _head_entropy(t).select("layer", place.alias("place"), F.col("entropy").alias(n))
    j = side(a, "x").join(side(b, "y"), ["layer", "place"])
    r = v.correlation("x", "y")
    return j.groupBy("layer").agg(F.count("*").alias("heads"), r6(F.avg("x")).alias("mean_a"), r6(F.avg("y")).alias("mean_b"), r6(F.avg(F.pow(F.col("x") - F.col("y"), 2))).alias("mse"), r6(F.avg(F.col("x") - F.col("y"))).alias("difference"), r6(r).alias("correlation"))


def overall_similarity(layers: DataFrame) -> DataFrame:
    """Mean cosine of compare_layers' rows; 0 without any common layer."""
    return layers.agg(r6(F.coalesce(F.avg("cosine"), F.lit(0.0))).alias("overall"))
