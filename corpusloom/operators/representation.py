"""Comparison of embeddings: retrieval, gaps, clusters and languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..storage import Scratch, written
from .blocks import block_of, crossed, few_rows, packed
from .confidence import r6
from .factors import factors, factors_by
from .neighbours import BLOCK, nearest
from .quantiles import quantiles

def pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Interleaved rows (even EN, next odd KO) as pair_id with en_ and ko_ columns; a last odd row is left out."""
    p = df.withColumn("pair_id", F.floor(F.col("idx") / 2))
    side = lambda r, n: p.where(F.col("idx") % 2 == r).select("pair_id", *(F.col(c).alias(f"{n}_{c}") for c in columns))
    return side(0, "en").join(side(1, "ko"), "pair_id")


def retrieval(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Share of rows whose nearest other row is their translation (all rows are candidates)."""
    best = nearest(df, df, 1, block)
    hit = F.col("other") == F.when(F.col("idx") % 2 == 0, F.col("idx") + 1).otherwise(F.col("idx") - 1)
    return best.agg(F.count("*").alias("n"), r6(F.avg(hit.cast("double"))).alias("accuracy"))


def parallel_retrieval(en: DataFrame, ko: DataFrame, block: int = BLOCK) -> DataFrame:
    """Accuracy of the best match in the other language, and mean and deviation of the pairs' similarity; sides of unequal length raise an error."""
    n = en.agg(F.count("*").alias("n")).union(ko.agg(F.count("*"))).collect()
    if n[0]["n"] != n[1]["n"]:
        raise ValueError(f"sides of {n[0]['n']} and {n[1]['n']} rows")
    best = nearest(en, ko, 1, block, skip_self=False).agg(r6(F.avg((F.col("idx") == F.col("other")).cast("double"))).alias("accuracy"))
    own = en.select("idx", F.col("v").alias("a")).join(ko.select("idx", F.col("v").alias("b")), "idx").agg(r6(F.avg(v.cosine(F.col("a"), F.col("b")))).alias("mean_similarity"), r6(F.stddev_pop(v.cosine(F.col("a"), F.col("b")))).alias("std_similarity"))
    return own.crossJoin(F.broadcast(best))


def retrieval_improvement(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Two results of parallel_retrieval: deltas, ratio (infinite from 0) and advice."""
    j = base.select(F.col("accuracy").alias("a"), F.col("mean_similarity").alias("s")).crossJoin(F.broadcast(tuned.select(F.col("accuracy").alias("b"), F.col("mean_similarity").alias("t"))))
    d = F.col("b") - F.col("a")
    return j.select(r6(d).alias("accuracy_delta"), r6(F.col("t") - F.col("s")).alias("similarity_delta"), F.when(F.col("a") == 0, F.lit(float("inf"))).otherwise(F.col("b") / F.nullif("a", F.lit(0.0))).alias("ratio"), F.when(d > 0.1, "use").when(d < -0.05, "reject").otherwise("neutral").alias("advice"))


def csls(df_a: DataFrame, df_b: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """Per pair of equal index 2 cos - r(x) - r(y), r the mean similarity to the k nearest of the other side."""
    mean = lambda q, i, n: nearest(q, i, k, block, skip_self=False).groupBy("idx").agg(F.avg("sim").alias(n))
    own = df_a.select("idx", F.col("v").alias("a")).join(df_b.select("idx", F.col("v").alias("b")), "idx")
    j = own.join(mean(df_a, df_b, "rx"), "idx").join(mean(df_b, df_a, "ry"), "idx")
    return j.select("idx", r6(2 * v.cosine(F.col("a"), F.col("b")) - F.col("rx") - F.col("ry")).alias("csls"))


def neighbour_consistency(a: DataFrame, b: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """Mean share of the k neighbours that two models have in common (divided by k even if there are fewer)."""
    one = nearest(a, a, k, block).select("idx", "other").join(nearest(b, b, k, block).select("idx", "other"), ["idx", "other"])
    n = a.agg(F.count("*").alias("n"))
    return one.agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select(r6(F.col("c") / (F.col("n") * k)).alias("consistency"))


def pair_distances(df: DataFrame) -> DataFrame:
    return pairs(df, ["v"]).select("pair_id", r6(v.distance(F.col("en_v"), F.col("ko_v"))).alias("distance"))


def distance_bands(df: DataFrame) -> DataFrame:
    """pair_id, distance, its band by the quartiles of all pairs, and the mean and deviation of all."""
    d = pair_distances(df)
    quartiles = quantiles(d, "distance", [0.5, 0.75]).select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p75"))
    q = d.agg(r6(F.avg("distance")).alias("mean"), r6(F.stddev_pop("distance")).alias("std")).crossJoin(quartiles)
    return d.crossJoin(F.broadcast(q)).select("pair_id", "distance", F.when(F.col("distance") >= F.col("p75"), "high").when(F.col("distance") >= F.col("p50"), "medium").otherwise("low").alias("band"), "mean", "std")


def gap_by_position(df: DataFrame, a: str = "base", b: str = "train") -> DataFrame:
    """place, gap of the EN and the KO row at that place (each in the order of idx) in two models, and the change; as far as both languages have rows."""
    side = lambda lang, n: df.where(F.col("lang") == lang).select(F.floor(F.col("idx") / 2).alias("place"), F.col(a).alias(f"{n}a"), F.col(b).alias(f"{n}b"))
    j = side("en", "en").join(side("ko", "ko"), "place")
    return j.select("place", r6(v.distance(F.col("ena"), F.col("koa"))).alias("base_gap"), r6(v.distance(F.col("enb"), F.col("kob"))).alias("train_gap"), r6(v.distance(F.col("enb"), F.col("kob")) - v.distance(F.col("ena"), F.col("koa"))).alias("change"))


def gap_summary(df: DataFrame, a: str = "base", b: str = "train") -> DataFrame:
    """Overall mean gap of two models, how it is called (bounds 0.5, 1 and 2), its consistency and the mean cosine."""
    m = F.col("gap")
    called = F.when(m < 0.5, "very_low").when(m < 1, "low").when(m < 2, "medium").otherwise("high")
    return gap(df, a, b).agg(F.avg("gap").alias("gap"), r6(F.avg("cosine")).alias("cosine")).select(r6(m).alias("gap"), called.alias("level"), r6(1 / (1 + m)).alias("consistency"), "cosine")


def gap(df: DataFrame, a: str = "base", b: str = "train") -> DataFrame:
    """Distance and cosine between two models' vectors of each row, with bands."""
    d, c = v.distance(F.col(a), F.col(b)), v.cosine(F.col(a), F.col(b))
    return df.withColumns({"gap": d, "cosine": c}).withColumns({"gap_band": F.when(F.col("gap") < 1, "small").when(F.col("gap") < 2, "medium").otherwise("large"), "cosine_band": F.when(F.col("cosine") > 0.9, "high").when(F.col("cosine") > 0.7, "medium").otherwise("low")})


def gap_panels(df: DataFrame, by: str) -> DataFrame:
    """Per group: mean gap and cosine, line of cosine by gap, its correlation and band, quartiles, consistency 1 / (1 + gap)."""
    g = gap(df)
    r = F.coalesce(v.correlation("gap", "cosine"), F.lit(0.0))
    quartiles = quantiles(g, "gap", [0.25, 0.75], [by]).select(F.col(by).alias("__by"), "q")
    told = g.groupBy(by).agg(r6(F.avg("gap")).alias("mean_gap"), r6(F.avg("cosine")).alias("mean_cosine"), r6(F.regr_slope("cosine", "gap")).alias("slope"), r6(F.regr_intercept("cosine", "gap")).alias("intercept"), r6(r).alias("correlation"), F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.3, "moderate").otherwise("weak").alias("strength"), r6(F.avg(1 / (1 + F.col("gap")))).alias("consistency"))
    names = [c for c in told.columns if c != "consistency"]
    return told.join(quartiles, told[by].eqNullSafe(F.col("__by")), "left").select(*names, r6(F.col("q")[0]).alias("q1"), r6(F.col("q")[1]).alias("q3"), "consistency")


def projected(df: DataFrame, pca: dict[str, np.ndarray], columns: list[str]) -> DataFrame:
    """df with each column's coordinates (array) on the principal directions; the directions, of the vectors' size, are literals of the plan."""
    dims = [F.array(*map(F.lit, pca["loadings"][:, i].tolist())) for i in range(pca["loadings"].shape[1])]
    mean = F.array(*map(F.lit, pca["mean"].tolist()))
    at = lambda c: F.array(*(v.dot(F.zip_with(v.doubles(F.col(c)), mean, lambda x, y: x - y), d) for d in dims))
    return df.withColumns({f"{c}_at": at(c) for c in columns})


def separation(at: DataFrame, base: str, train: str, lang: str = "lang") -> DataFrame:
    """at: rows with coordinates of two models. How far the languages' means are apart on the first direction over both models, the mean
    absolute shift between the models on each, and the ranges of the second by language."""
    both = at.select(lang, F.explode(F.array(base, train)).alias("c"), F.lit(0))
    mean = lambda name: F.avg(F.when(F.col(lang) == name, F.col("c")[0]))
    span = lambda name: F.max(F.when(F.col(lang) == name, F.col("c")[1])) - F.min(F.when(F.col(lang) == name, F.col("c")[1]))
    apart = both.agg(r6(F.abs(mean("en") - mean("ko"))).alias("language_separation"), r6(span("en")).alias("en_range"), r6(span("ko")).alias("ko_range"))
    shift = at.agg(*(r6(F.avg(F.abs(F.col(base)[i] - F.col(train)[i]))).alias(f"shift_{i + 1}") for i in (0, 1)))
    return apart.crossJoin(F.broadcast(shift))


def cka_band(x: float) -> str:
    return next((name for least, name in ((0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")) if x >= least), "very_low")


def contingency(df: DataFrame, lang: str, cluster: str) -> DataFrame:
    return df.groupBy(lang, cluster).agg(F.count("*").alias("n"))


def purity(df: DataFrame, lang: str, cluster: str) -> DataFrame:
    """Per language the share of its most frequent cluster (ties: the smallest)."""
    c = contingency(df, lang, cluster)
    return c.groupBy(lang).agg(F.min_by(cluster, F.struct(-F.col("n"), F.col(cluster))).alias("cluster"), r6(F.max("n") / F.sum("n")).alias("purity"))


def clustering_agreement(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Adjusted Rand index and normalised mutual information of two labellings, from their (small) contingency table."""
    rows = df.groupBy(a, b).agg(F.count("*").alias("n")).collect()
    t: dict = {}
    for r in rows:
        t[r[a], r[b]] = r["n"]
    ra, rb = {}, {}
    for (x, y), n in t.items():
        ra[x], rb[y] = ra.get(x, 0) + n, rb.get(y, 0) + n
    n = sum(ra.values())
    two = lambda z: sum(k * (k - 1) / 2 for k in z)
    index, sa, sb, all_pairs = two(t.values()), two(ra.values()), two(rb.values()), n * (n - 1) / 2
    expected, most = (sa * sb / all_pairs if all_pairs else 0.0), (sa + sb) / 2
    h = lambda z: -sum(k / n * np.log(k / n) for k in z)
    mi = sum(k / n * np.log(k * n / (ra[x] * rb[y])) for (x, y), k in t.items())
    return {"ari": (index - expected) / (most - expected) if most != expected else 1.0, "nmi": float(mi / ((h(ra.values()) + h(rb.values())) / 2)) if len(ra) + len(rb) > 2 else 1.0}


def silhouette(df: DataFrame, cluster: str, column: str = "v", block: int = 1024) -> DataFrame:
    """Mean silhouette by Euclidean distance: (b - a) / max(a, b), a the mean distance to the row's own cluster, b to the nearest other; 0 for a row alone.

    All pairs by nature: blocks meet by a cartesian product, and a task sums each row's distances by cluster over its part of the blocks.
    """
    n = max(1, -(-df.count() // block))
    rows = df.select(F.col("idx").cast("long").alias("key"), F.size("v").alias("dim"), v.doubles(F.col(column)).alias("v"), F.col(cluster).cast("string").alias("c"), F.pmod(F.xxhash64("idx"), F.lit(n)).alias("tile"))
    names = ["idx", "own", "other", "d", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile, a, b = batch.column("a_tile")[i].as_py(), block_of(batch, i, "a_"), block_of(batch, i, "b_")
                key, labels, sums = held.setdefault(tile, (a["key"].copy(), batch.column("a_labels")[i].as_py(), {}))
                found, at = np.unique(np.array(batch.column("b_labels")[i].as_py()), return_inverse=True)
                member = np.eye(len(found))[at]
                x, y = a["x"], b["x"]
                d = np.zeros((len(x), len(found)))
                for s in range(0, len(x), 256):
                    p = x[s : s + 256]
                    far = np.sqrt(np.maximum(0, (p * p).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * p @ y.T))
                    if tile == batch.column("b_tile")[i].as_py():
                        far[key[s : s + 256][:, None] == b["key"][None, :]] = 0
                    d[s : s + 256] = far @ member
                for name, column, size in zip(found.tolist(), d.T, member.sum(axis=0)):
                    before, number = sums.get(name, (0, 0))
                    sums[name] = before + column, number + int(size)
        for key, labels, sums in held.values():
            for name, (d, size) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(labels, pa.string()), pa.array([name] * len(key), pa.string()), pa.array(d), pa.array([size] * len(key), pa.int64())], names=names)

    with Scratch(df.sparkSession) as scratch, few_rows(df.sparkSession):
        tiles = scratch.written(packed(rows, "c"), "tiles")
        sums = written(crossed(tiles, tiles).mapInArrow(run, "idx long, own string, other string, d double, n long"), "distances")
    sums = sums.groupBy("idx", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    each = sums.groupBy("idx").agg(F.max(F.when(same, F.col("d") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    return each.agg(r6(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))).alias("silhouette"))


def purity_change(base: DataFrame, tuned: DataFrame, lang: str) -> DataFrame:
    """Two results of `purity`: each language's purities and the improvement."""
    a, b = base.select(lang, F.col("purity").alias("base")), tuned.select(lang, F.col("purity").alias("tuned"))
    return a.join(b, lang).select(lang, "base", "tuned", r6(F.col("tuned") - F.col("base")).alias("improvement"))


def by_language(df: DataFrame, a: str = "base", b: str = "train", lang: str = "lang", k: int = 5) -> dict[str, dict[str, float | None]]:
    """CKA (from two rows on), SVCCA (from three) and neighbour consistency (of at most k and one less than the rows) of each language; None under that, or for k = 0, which spares the search.

    One pass of factors and one search a model for all languages: vectors only meet those of their own."""
    told, rows = factors_by(df, a, b, lang), df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    side = lambda c: nearest(*[rows.select("idx", F.col(lang).cast("string").alias("by"), F.col(c).alias("v"))] * 2, k, by="by").select("idx", "other")
    shared = side(a).join(side(b), ["idx", "other"]).join(rows.select("idx", F.col(lang).cast("string").alias("by")), "idx").groupBy("by").agg(F.count("*").alias("n")).collect() if k else []  # a row a language
    common = {r["by"]: r["n"] for r in shared}
    out = {}
    for name, m in sorted(told.items(), key=lambda x: (x[0] is not None, x[0])):
        near = min(k, m.n - 1)
        out[name] = {"cka": m.cka() if m.n > 1 else None, "svcca": m.svcca() if m.n > 2 else None, "consistency": round(common.get(name, 0) / (m.n * near), 6) if near > 0 else None}
    return out


def cross_language(df: DataFrame, columns: tuple[str, ...] = ("base", "train"), k: int = 5) -> dict[str, dict[str, float]]:
    """For each model CKA, SVCCA and neighbour consistency (k = 0: none, without a search) between the languages: of a pair's EN rows against its KO rows."""
    both = pairs(df, list(columns))
    out = {}
    for c in columns:
        m = factors(both, f"en_{c}", f"ko_{c}")
        side = lambda lang, c=c: both.select(F.col("pair_id").alias("idx"), F.col(f"{lang}_{c}").alias("v"))
        near = min(k, m.n - 1)
        out[c] = {"cka": m.cka(), "svcca": m.svcca(), "consistency": neighbour_consistency(side("en"), side("ko"), near).first()[0] if near > 0 else None}
    return out


def kmeans(df: DataFrame, k: int, column: str = "v", seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("__f", array_to_vector(v.doubles(F.col(column))))
    return KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(ready).transform(ready).drop("__f")


def language_similarity(df: DataFrame, lang: str = "lang") -> DataFrame:
    """a, b, mean and population deviation of the cosines within and between languages, over all pairs of different rows.

    Both come from moments of the unit vectors u (their sums, and the sums of u u', whose products are the sums of the squared
    cosines), of a size that follows the dimensions: no pairs. Zero vectors are left out.
    """
    n = v.norm(F.col("v"))
    unit = df.where(n > 0).select(lang, F.transform(v.doubles(F.col("v")), lambda x: x / n).alias("u"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = np.array(batch.column(lang).to_pylist(), object)
            x = np.array(batch.column("u").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            for name in set(names):
                y = np.hstack((np.ones((int((names == name).sum()), 1)), x[names == name]))
                sums[name] = sums.get(name, 0) + y.T @ y
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([m.astype("f8").tobytes() for m in sums.values()], pa.binary())], names=["lang", "m"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"lang": [t["lang"][0].as_py()], "m": pa.array([sum(np.frombuffer(x, "f8") for x in t["m"].to_pylist()).tobytes()], pa.binary())})

    parts = unit.mapInArrow(part, "lang string, m binary").groupBy("lang").applyInArrow(add, "lang string, m binary").collect()  # one of each language
    moments = {r["lang"]: (m := np.frombuffer(bytes(r["m"]), "f8")).reshape(int(np.sqrt(len(m))), -1) for r in parts}
    rows = []
    for a in sorted(moments):
        for b in sorted(x for x in moments if x >= a):
            p, q, same = moments[a], moments[b], a == b
            pairs_n = p[0, 0] * (q[0, 0] - same)
            if not pairs_n:
                continue
            mean = (p[0, 1:] @ q[0, 1:] - same * p[0, 0]) / pairs_n
            square = ((p[1:, 1:] * q[1:, 1:]).sum() - same * p[0, 0]) / pairs_n
            rows.append((a, b, round(float(mean), 6), round(float(np.sqrt(max(0.0, square - mean * mean))), 6)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, mean_similarity double, std_similarity double")


def intra_distance(df: DataFrame, lang: str = "lang", column: str = "v") -> DataFrame:
    """Mean cosine distance of a language's rows over all ordered pairs, each row's pair with itself (distance 0) among them.

    From sums of unit vectors: one pass, no pairs. A zero vector is at distance 1 from the others; languages of one row are left out.
    """
    rows = df.where(F.col(column).isNotNull())
    n = v.norm(F.col(column))
    number = rows.groupBy(lang).agg(F.count("*").alias("n"), F.count_if(n > 0).alias("units")).where("n > 1")
    unit = rows.where(n > 0).select(lang, F.posexplode(F.transform(v.doubles(F.col(column)), lambda x: x / n)).alias("d", "x"))
    dot = unit.groupBy(lang, "d").agg(F.sum("x").alias("x")).groupBy(lang).agg(F.sum(F.col("x") * F.col("x")).alias("dot"))
    inside = F.col("n") * (F.col("n") - 1) - (F.coalesce("dot", F.lit(0.0)) - F.col("units"))
    return number.join(dot, lang, "left").select(lang, r6(inside / (F.col("n") * F.col("n"))).alias("distance"))


def centre_distances(df: DataFrame, cluster: str = "cluster", column: str = "v") -> DataFrame:
    """a, b, distance: cosine distance of the clusters' centres, each pair once."""
    long = df.select(F.col(cluster).alias("c"), F.posexplode(v.doubles(F.col(column))).alias("d", "x")).groupBy("c", "d").agg(F.avg("x").alias("x"))
    length = long.groupBy("c").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    unit = long.join(length, "c").select("c", "d", F.coalesce(F.col("x") / F.nullif(F.col("l"), F.lit(0.0)), F.lit(0.0)).alias("x"))
    a, b = unit.select(F.col("c").alias("a"), "d", F.col("x").alias("p")), unit.select(F.col("c").alias("b"), "d", F.col("x").alias("q"))
    return a.join(b, "d").where("a < b").groupBy("a", "b").agg(r6(1 - F.sum(F.col("p") * F.col("q"))).alias("distance"))


def pair_cka(df: DataFrame, a: str = "base", b: str = "train") -> DataFrame:
    """pair_id, cka of the two rows (idx even, next odd) of each whole pair.

    Two centred samples are plus and minus half their difference, so that CKA is 1 unless a model has both rows alike; then it is 0.
    """
    two = df.groupBy(F.floor(F.col("idx") / 2).alias("pair_id")).agg(*(F.collect_list(F.struct("idx", c)).alias(c) for c in (a, b))).where(F.size(a) == 2)
    return two.select("pair_id", F.when((F.col(a)[0][a] != F.col(a)[1][a]) & (F.col(b)[0][b] != F.col(b)[1][b]), 1.0).otherwise(0.0).alias("cka"))


def pair_cka_panel(pairs: DataFrame) -> DataFrame:
    """Best and worst pair (the first of equals) with their values, and the variance."""
    best, worst = (F.struct(x.alias("x"), F.col("pair_id").alias("pair_id")) for x in (-F.col("cka"), F.col("cka")))
    return pairs.agg(F.min(best)["pair_id"].alias("best_pair"), F.max("cka").alias("best"), F.min(worst)["pair_id"].alias("worst_pair"), F.min("cka").alias("worst"), r6(F.var_pop("cka")).alias("variance"))


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (i, j, x): correlation, MSE, MAE and differences; shapes that differ raise an error."""
    j = a.withColumnRenamed("x", "p").join(b.withColumnRenamed("x", "q"), ["i", "j"], "full_outer")
    d = F.col("p") - F.col("q")
    wrong = F.raise_error(F.lit("matrices have different shapes"))
    return j.select(F.when(F.col("p").isNull() | F.col("q").isNull(), wrong.cast("double")).otherwise(F.col("p")).alias("p"), "q").agg(r6(v.correlation("p", "q")).alias("correlation"), r6(F.avg(d * d)).alias("mse"), r6(F.avg(F.abs(d))).alias("mae"), r6(F.max(F.abs(d))).alias("max_difference"), r6(F.avg(d)).alias("mean_difference"), r6(F.stddev_pop(d)).alias("std_difference"))
