"""Operators that must hold at scale: exact quantiles, numbering, clusters and neighbours by cells, factors of matrices."""

from __future__ import annotations

import math
import os
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.plans import inference, queries
from corpusloom.operators import attention, bloom, confidence, corpus, factors, mixing, neighbours, panels, quantiles, representation, scoring

POINTS = [0, 0.05, 0.25, 0.5, 0.9, 0.999, 1]


def numpy_quantiles(rows, points=POINTS):
    told = {}
    for by, x in rows:
        if x is not None and not math.isnan(x):
            told.setdefault(by, []).append(x)
    return {by: (len(x), np.quantile(x, points)) for by, x in told.items()}


@pytest.mark.parametrize("limit", [1, 7, 100, 1 << 20])
def test_quantiles_of_groups(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.choice((rng.gauss(0, 1), 0.0, -0.0, 2.5, float(rng.randrange(5)), None, math.nan))) for _ in range(3000)]
    rows += [("one", 1.5), ("none", None), ("inf", math.inf), ("inf", 1.0), ("inf", -math.inf)]
    df = spark.createDataFrame(rows, "x string, value double").select(F.col("x").alias("part"), F.col("value").alias("w"), F.lit(1).alias("g0"))
    got = {r["part"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, "w", POINTS, ["part"], limit=limit, cells=8).collect()}
    want = numpy_quantiles([r for r in rows if r[0] != "inf"])
    assert got.pop("inf")[0] == 3
    assert got.keys() == want.keys()
    for by, (n, q) in want.items():
        assert got[by][0] == n and np.allclose(got[by][1], q, rtol=0, atol=1e-12)
    assert quantiles.quantiles(df.limit(0), "w", POINTS, ["part"], limit=limit).count() == 0
    assert quantiles.quantiles(df.limit(0), "w", POINTS, limit=limit).count() == 0


def test_quantiles_of_a_million_values(spark, monkeypatch):
    """No task ranks more than the limit: what is ranked at the end are the rows of the last parts."""
    df = spark.range(1_000_000).select(F.randn(3).alias("x"))
    most = []
    original = quantiles.Scratch.written

    def spy(self, d, name):
        out = original(self, d, name)
        if name.startswith("rows"):
            most.append(out.groupBy("part").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles.Scratch, "written", spy)
    got = quantiles.quantiles(df, "x", POINTS, limit=2000).first()
    want = np.quantile(np.array([r[0] for r in df.collect()]), POINTS)
    assert got["n"] == 1_000_000 and np.allclose(got["q"], want, rtol=0, atol=1e-12)
    assert most and most[-1] <= 2000


def test_quantiles_where_they_are_used(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 100.0), (None, None)], "k string, x double")
    boxed = {r["k"]: r for r in panels.boxes(df, "x", ["k"]).collect()}
    assert (boxed["a"]["q1"], boxed["a"]["median"], boxed["a"]["q3"], boxed["a"]["outside"]) == (1.75, 3.0, 28.0, 1)
    assert boxed[None]["median"] is None and boxed[None]["n"] == 0
    assert corpus.percentiles_linear(df.limit(0), "x").first()["median"] is None
    assert corpus.percentiles_linear(df, "x").first()["p95"] == round(float(np.quantile([1, 2, 4, 100], 0.95)), 6)


def test_softmax_of_large_values(spark):
    row = spark.createDataFrame([([1000.0, 999.0],), ([-1e4, -1e4],), ([],), (None,)], "a array<double>").select(vectors.softmax(F.col("a")).alias("p")).collect()
    e = math.exp(-1)
    assert np.allclose(row[0]["p"], [1 / (1 + e), e / (1 + e)]) and row[1]["p"] == [0.5, 0.5]
    assert row[2]["p"] == [] and row[3]["p"] is None


def test_language_bias_with_failed_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 1.5), (3.0, 2.0, None, 1.0)], "a double, b double, c double, d double")
    assert tuple(confidence.language_bias(df, ("a", "b"), ("c", "d")).first()) == (1.0, 0.5, 0.5, 1.0, 1)
    assert tuple(confidence.language_bias(df, ("a", "b"), ("c", "d"), placeholders=True).first()) == (0.55, 0.3, 0.25, 1.0, 1)


@pytest.mark.parametrize("keys", [["a1", "b2", "c3", "c3", None], [3, 1, 2, 2, None], [1.5, -2.0, 0.0, 0.0, None]])
def test_numbering_by_any_key(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {'string' if isinstance(keys[0], str) else 'double' if isinstance(keys[0], float) else 'long'}, x long")
    got = sorted((r["index"], r["k"]) for r in mixing.numbered(df, F.col("k")).collect() if r["k"] is not None)
    assert [i for i, _ in got] == [1, 2, 3, 4] and [k for _, k in got] == sorted(k for k in keys if k is not None)
    mixed = mixing.combine({"d": df, "e": df}, {"d": 2, "e": 0.4}, "train", "k", ["x"])
    assert sorted(r["id"] for r in mixed.collect()) == ["d_0_train", "d_1_train", "e_0_train", "e_1_train"]
    assert mixing.synthetic_ids(df.limit(0), "d", "train", F.col("k")).count() == 0


def test_numbering_of_one_hot_key(spark):
    df = spark.range(20_000).select((F.col("id") % 3 % 2).cast("string").alias("k"))
    assert sorted(r["index"] for r in mixing.numbered(df, F.col("k")).collect()) == list(range(20_000))


def test_parallel_sides_of_unequal_length(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "idx long, v array<double>")
    with pytest.raises(ValueError):
        representation.parallel_retrieval(df, df.limit(3))


def clustered(rng, n, centres=40, dim=12, spread=0.05):
    c = rng.normal(size=(centres, dim)) * 5
    x = c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim)) * spread
    x[rng.integers(n, size=max(1, n // 200))] = 0
    return x


def vectors_frame(spark, x, shift=0):
    return spark.createDataFrame([(i + shift, r) for i, r in enumerate(x.tolist())], "idx long, v array<double>")


def similarities(a, b):
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
    return unit(a) @ unit(b).T


@pytest.mark.parametrize(("k", "block", "own"), [(1, 40, True), (5, 16, True), (7, 64, False), (900, 128, True)])
def test_nearest_by_cells(spark, k, block, own):
    rng = np.random.default_rng(k)
    x = clustered(rng, 600)
    x[5:25] = x[4]  # ties go to the smaller idx
    y = x if own else clustered(rng, 300)
    items, queries = vectors_frame(spark, x), vectors_frame(spark, y)
    got = {}
    for r in neighbours.nearest(queries, items, k, block, skip_self=own).collect():
        got.setdefault(r["idx"], {})[r["rank"]] = (r["other"], round(r["sim"], 9))
    sim = similarities(y, x)
    for q in range(len(y)):
        order = [j for j in np.lexsort((np.arange(len(x)), -np.round(sim[q], 9))) if not (own and j == q)][:k]
        assert [got[q][i + 1][0] for i in range(len(order))] == order
        assert np.allclose([got[q][i + 1][1] for i in range(len(order))], sim[q][order], atol=1e-8)


def test_nearest_leaves_tiles_out(spark, monkeypatch):
    met = []
    original = neighbours.pairs_of_tiles
    monkeypatch.setattr(neighbours, "pairs_of_tiles", lambda d: met.append(original(d).count()) or original(d))
    x = clustered(np.random.default_rng(1), 4000)
    df = vectors_frame(spark, x)
    neighbours.nearest(df, df, 3, 100).count()
    tiles = 4000 // 100
    assert sum(met) < tiles * tiles / 3


def test_pairs_of_tiles_copy_no_vectors(spark, monkeypatch):
    """Without structure all tiles meet; what is written must not grow with their pairs."""
    rows = []
    original = neighbours.Scratch.written
    monkeypatch.setattr(neighbours.Scratch, "written", lambda self, d, name: (out := original(self, d, name), rows.append(out.count()))[0])
    x = np.random.default_rng(3).normal(size=(400, 16))
    df = vectors_frame(spark, x)
    got = {(r["i"], r["j"]) for r in neighbours.similar(df, 0.5, 20).collect()}
    assert got == {(i, j) for i, j in np.argwhere(similarities(x, x) >= 0.5) if i < j}
    neighbours.nearest(df, df, 2, 20).count()
    neighbours.dbscan(df, 0.2, 2, 20).count()
    assert len(rows) > 8 and max(rows) <= 400


def test_silhouette_of_many_blocks(spark, monkeypatch):
    met = []
    original = representation.crossed
    monkeypatch.setattr(representation, "crossed", lambda a, b: (out := original(a, b), met.append(out._jdf.queryExecution().executedPlan().toString()))[0])
    x = np.random.default_rng(4).normal(size=(90, 6))
    label = np.arange(90) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    a = [d[i][label == label[i]].sum() / 29 for i in range(90)]
    b = [min(d[i][label == c].mean() for c in range(3) if c != label[i]) for i in range(90)]
    df = vectors_frame(spark, x).withColumn("c", F.col("idx") % 3)
    assert representation.silhouette(df, "c", block=9).first()[0] == pytest.approx(np.mean([(q - p) / max(p, q) for p, q in zip(a, b)]), abs=2e-6)
    assert len(met) == 1 and "CartesianProduct" in met[0]


def test_cka_alone_needs_no_search(spark, monkeypatch):
    monkeypatch.setattr(representation, "nearest", lambda *_, **__: pytest.fail("a search"))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "ek"[i % 2], rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for i in range(20)], "idx long, lang string, base array<double>, train array<double>")
    assert {n: r["consistency"] for n, r in representation.by_language(df, k=0).items()} == {"e": None, "k": None}
    assert all(r["consistency"] is None and r["cka"] > 0 for r in representation.cross_language(df, k=0).values())


def test_nearest_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [-1.0, 0.0]), (6, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "idx long, v array<double>, tile string")
    got = {(r["idx"], r["rank"]): (r["other"], r["sim"]) for r in neighbours.nearest(df, df, 2).collect()}
    assert got == {(1, 1): (6, 1.0), (1, 2): (2, 0.0), (2, 1): (1, 0.0), (2, 2): (5, 0.0), (5, 1): (2, 0.0), (5, 2): (1, -1.0), (6, 1): (1, 1.0), (6, 2): (2, 0.0)}
    assert neighbours.nearest(df.limit(0), df, 2).count() == 0 and neighbours.nearest(df, df.limit(0), 2).count() == 0
    assert neighbours.similar(df.limit(0), 0.5).count() == 0
    assert {(r["i"], r["j"]) for r in neighbours.similar(df, 0.0).collect()} == {(1, 2), (1, 6), (2, 5), (2, 6)}


def clusters_by_hand(x, eps, least):
    linked = similarities(x, x) >= 1 - eps
    np.fill_diagonal(linked, True)
    core = linked.sum(axis=1) >= least
    name = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if name[i] < 0:
            todo = [i]
            name[i] = i
            while todo:
                for j in np.flatnonzero(linked[todo.pop()] & core & (name < 0)):
                    name[j] = i
                    todo.append(j)
    return [int(name[i]) if core[i] else min((int(name[j]) for j in np.flatnonzero(linked[i] & core)), default=-1) for i in range(len(x))]


@pytest.mark.parametrize(("eps", "least", "block", "spread"), [(0.002, 4, 30, 0.3), (0.01, 6, 64, 0.5), (0.3, 3, 50, 2.0), (0.05, 12, 25, 1.0)])
def test_density_clusters_by_cells(spark, eps, least, block, spread):
    x = clustered(np.random.default_rng(least), 700, spread=spread)
    want = clusters_by_hand(x, eps, least)
    got = {r["idx"]: r["cluster"] for r in neighbours.dbscan(vectors_frame(spark, x), eps, least, block).collect()}
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 2 and -1 in want


def test_density_clusters_of_a_dense_ball(spark, monkeypatch):
    """20,000 rows that are all linked: 200 million links, of which none is written."""
    written = []
    original = neighbours.Scratch.written
    monkeypatch.setattr(neighbours.Scratch, "written", lambda self, d, name: (out := original(self, d, name), written.append((name, out.count())))[0])
    rng = np.random.default_rng(0)
    x = np.vstack((np.ones((20_000, 8)) + rng.normal(size=(20_000, 8)) * 0.01, -np.ones((1, 8))))
    got = neighbours.dbscan(vectors_frame(spark, x), 0.05, 5).groupBy("cluster").count().collect()
    assert sorted((r["cluster"], r["count"]) for r in got) == [(-1, 1), (0, 20_000)]
    assert max(n for _, n in written) < 20 * len(x)


def test_density_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "idx long, v array<double>")
    assert {r["idx"]: r["cluster"] for r in neighbours.dbscan(df, 0.1, 2).collect()} == {1: -1, 2: -1, 3: -1}
    assert neighbours.dbscan(df.limit(0), 0.1, 2).count() == 0
    with pytest.raises(ValueError):
        neighbours.dbscan(df, 1.5, 2)


def svcca_by_hand(x, y, keep=0.99, ridge=1e-6):
    def directions(m):
        u, s, _ = np.linalg.svd(m.T, full_matrices=False)
        held = np.cumsum(s**2) / np.sum(s**2)
        return u[:, : max(1, min(int(np.argmax(held >= keep)) + 1, len(s), len(m) - 1))]

    p, q = x @ directions(x), y @ directions(y)
    k = min(p.shape[1], q.shape[1], len(x) - 1)
    p, q = (z[:, :k] - z[:, :k].mean(axis=0) for z in (p, q))
    pp, qq, pq = (a.T @ b / (len(x) - 1) for a, b in ((p, p), (q, q), (p, q)))
    white = lambda c: np.linalg.inv(np.linalg.cholesky(c + ridge * np.eye(k)))
    return np.clip(np.linalg.svd(white(pp) @ pq @ white(qq), compute_uv=False), 0, 1).mean()


def models(spark, x, y, parts=7, lang=None):
    rows = [(i, a.tolist(), b.tolist(), lang[i] if lang else "en") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "idx long, base array<double>, train array<double>, lang string").repartition(parts)


def test_factors_of_ill_conditioned_vectors(spark):
    """Directions of 1 to 10 ** -8 around a mean of 1,000: products of the columns would lose the small ones."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = rng.normal(size=(900, 8)) * 10.0 ** -np.arange(0, 8 * 8 / 7, 8 / 7)[:8] @ turn
    m = factors.factors(models(spark, x, x[:, ::-1]), "base", "train")
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    got = np.linalg.svd(m.x, compute_uv=False)
    assert np.allclose(got, s, rtol=1e-6) and s[0] / s[-1] > 1e7
    assert m.n == 900 and np.allclose(m.mx, x.mean(axis=0), atol=1e-12)


@pytest.mark.parametrize(("n", "keep"), [(300, 0.99), (300, 0.8), (5, 0.99), (3, 1.0)])
def test_statistics_of_factors(spark, n, keep):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 6)) + 3
    y = x @ rng.normal(size=(6, 6)) + rng.normal(size=(n, 6)) * 0.3
    m = factors.factors(models(spark, x, y, 3), "base", "train")
    assert m.svcca(keep) == pytest.approx(svcca_by_hand(x, y, keep), abs=1e-6)
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    assert m.cka() == pytest.approx(np.linalg.norm(cx.T @ cy) ** 2 / (np.linalg.norm(cx.T @ cx) * np.linalg.norm(cy.T @ cy)))
    nuclear = np.linalg.svd(cx.T @ cy, compute_uv=False).sum()
    assert m.procrustes()["scale"] == pytest.approx(nuclear / (cx**2).sum())
    both = np.vstack((x, y))
    w = np.linalg.svd(both - both.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(m.pca(2)["explained"], w[:2] / w.sum())


def test_svcca_without_a_cholesky_factor(spark):
    x = np.column_stack((np.arange(10.0), np.zeros(10)))
    m = factors.factors(models(spark, x, x), "base", "train")
    assert m.svcca(1.0, 0.0) == pytest.approx(1.0) and m.svcca(1.0, -1.0) > 0
    flat = factors.factors(models(spark, np.ones((4, 2)), np.ones((4, 2))), "base", "train")
    assert flat.cka() == 0.0 and flat.svcca() == pytest.approx(0.0, abs=1e-6) and flat.svcca(0.99, 0.0) == 0.0


def test_languages_in_one_pass(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=(60, 5))
    lang = ["en" if i % 3 else "ko" for i in range(58)] + ["de", None]
    df = models(spark, x, y, 4, lang)
    told = representation.by_language(df, k=4)
    assert told.keys() == {"en", "ko", "de", None} and told["de"] == told[None] == {"cka": None, "svcca": None, "consistency": None}
    for name in ("en", "ko"):
        own = [i for i in range(60) if lang[i] == name]
        top = [[set(np.argsort(-s, kind="stable")[:4]) for s in similarities(z[own], z[own]) - 3 * np.eye(len(own))] for z in (x, y)]
        assert told[name]["consistency"] == pytest.approx(np.mean([len(a & b) / 4 for a, b in zip(*top)]), abs=1e-6)
        assert told[name]["svcca"] == pytest.approx(svcca_by_hand(x[own], y[own]), abs=1e-6)
    cross = representation.cross_language(df)
    assert cross["base"]["svcca"] == pytest.approx(svcca_by_hand(x[::2], x[1::2]), abs=1e-6) and 0 < cross["train"]["cka"] < 1


def test_factors_of_nothing(spark):
    with pytest.raises(ValueError):
        factors.factors(models(spark, np.ones((1, 2)), np.ones((1, 2))).limit(0), "base", "train")


def test_attention_blocks(spark):
    rows = [("a", 0, 0, 0, 0.5), ("a", 0, 0, 1, 0.5), ("a", 1, 0, 0, 1.0), ("a", 0, 1, 2, 1.0), ("a", 1, 1, 0, 0.25), ("a", 1, 1, 1, 0.75)]
    b = attention.blocks(spark.createDataFrame(rows, "layer string, head int, i long, j long, w double"))
    got = {(r["i"], h["head"]): h["w"] for r in b.collect() for h in r["heads"]}
    assert got == {(0, 0): [0.5, 0.5], (0, 1): [1.0], (1, 0): [0.0, 0.0, 1.0], (1, 1): [0.25, 0.75]}
    assert {tuple(r) for r in attention.long(b).where("w > 0").collect()} == {tuple(r) for r in rows}
    flow = attention.flow(b, 0).first()
    assert (flow["forward"], flow["backward"], flow["local"]) == (0.375, 0.0625, 0.5625)
    entropy = {r["head"]: r["entropy"] for r in attention.head_entropy(b).collect()}
    assert entropy[0] == pytest.approx(math.log(2) / 2, abs=1e-6)
    assert {(r["j"], r["importance"]) for r in attention.token_importance(b).collect()} == {(0, 0.4375), (1, 0.3125), (2, 0.25)}
    assert attention.self_attention(b).where("head = 1").first()["mean"] == 0.875
    assert attention.compare_layers(b, b).first()["correlation"] == 1.0
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, []), ("b", 0, [(0, None), (1, [1.0])])], "layer string, i long, heads array<struct<head:int,w:array<double>>>")
    assert attention.flow(odd).where("layer = 'b'").first()["local"] == 1.0 and attention.layer_entropy(odd).count() == 2
    assert attention.head_entropy(b.limit(0)).count() == 0


def test_weights_of_attention_are_not_shuffled(spark, sf_dir):
    b = queries.attention_blocks(spark, sf_dir)
    for measure in (attention.head_entropy, attention.layer_entropy, attention.distance, attention.flow, attention.token_importance, attention.self_attention):
        plan = measure(b)._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.rindex("Exchange") :]  # of the first shuffle: it takes what an aggregate left
        assert "partial_" in below and plan.count("Exchange") <= 2


GPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bytes_bpe():
    from tokenizers import Tokenizer

    if not hasattr(bytes_bpe, "library"):
        bytes_bpe.library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        bytes_bpe.library.encode_special_tokens = True
    return bytes_bpe.library


def library_ids(text):
    return bytes_bpe().encode(text, add_special_tokens=False).ids


def piece_ids(piece):
    from tokenizers import Tokenizer

    if not hasattr(piece_ids, "library"):
        piece_ids.library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        piece_ids.library.encode_special_tokens = True
    return piece_ids.library.encode(piece, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1 << 30, 37, 5])
def test_encoding_of_conversations_in_one_pass(spark, sf_dir, most):
    """Ids and labels of all conversations as by tokenising every prefix, also where the cut falls inside a turn."""
    turns = queries.table(spark, sf_dir, "conversations").selectExpr("conv_id", "struct(turn, if(role in ('system', 'user', 'assistant'), role, 'user') as role, coalesce(text, '') as content) as t")
    m = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    odd = spark.createDataFrame([(-1, [("user", "  a\n\n b "), ("assistant", ""), ("user", " \n"), ("assistant", "it's 's"), ("assistant", "더 ")]), (-2, [("assistant", "x")]), (-3, [("user", "")])], "conv_id long, messages array<struct<role:string,content:string>>")
    m = m.unionByName(odd.select("conv_id", "messages"))
    pick = lambda df: {r["conv_id"]: (r["input_ids"], r["labels"]) for r in df.collect()}
    got, want = pick(mixing.encode(m, mixing.Pieces(GPT, piece_ids), most=most)), pick(mixing.encode(m, library_ids, most=most))
    assert got == want and len(got) > 20 and any(mixing.MASK in labels for _, labels in got.values())


def test_encoding_grows_with_the_text():
    seen = []
    tokenizer = mixing.Pieces(GPT, lambda s: [len(s)])
    text = "".join(f"<|user|>\nword number {i} \n" for i in range(4000))
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    original = type(tokenizer).__call__
    try:
        type(tokenizer).__call__ = lambda self, t: seen.append(len(t)) or original(self, t)
        ids, counts = tokenizer.prefixes(text, ends)
    finally:
        type(tokenizer).__call__ = original
    assert ids == tokenizer(text[: ends[-1]]) and sum(seen) < 3 * len(text)
    assert [counts[k] for k in (0, 999, 5000)] == [len(tokenizer(text[: ends[k]])) for k in (0, 999, 5000)]


def test_correlation_without_variance(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 9.0), ("a", 3.0, 7.0), ("b", 1.0, 1.0), ("b", 1.0, 5.0), ("c", None, None)]
    got = {r["k"]: r["r"] for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(vectors.correlation("x", "y").alias("r")).collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and got["b"] is None and got["c"] is None


def prompts_frame(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "id long, prompt string").repartition(8)


def killing():
    def generate(p):
        if p == "p57":
            raise SystemExit("killed")
        return p.upper()

    return generate


def shouting():
    return lambda p: p.upper()


def test_outputs_survive_a_killed_run(spark, tmp_path):
    df, folder = prompts_frame(spark, 200), f"file://{tmp_path}/out"
    with pytest.raises(PythonException):
        inference.saved(df, folder, "id", killing, batch=5, in_all=4)
    before = {r["id"] for r in inference.committed(spark, folder, "id long, model_raw_output string").collect()}
    assert before and len(before) < 200  # some batches were whole
    more = df.unionByName(spark.createDataFrame([(500, "new"), (500, "new"), (None, "no key")], df.schema))
    out = inference.saved(more, folder, "id", shouting, batch=30).collect()
    assert sorted(r["id"] for r in out) == [*range(200), 500]
    assert all(r["model_raw_output"] == (f"P{r['id']}" if r["id"] < 500 else "NEW") for r in out)
    assert inference.saved(more, folder, "id", killing).count() == 201  # nothing is left to ask
    assert inference.saved(df.limit(0), f"{folder}-empty", "id", shouting).count() == 0


@pytest.mark.parametrize(("at_once", "in_all"), [(5, 5), (2, 6), (5, 3)])
def test_calls_at_once_over_all_partitions(spark, tmp_path, at_once, in_all):
    top = str(tmp_path)

    def make():
        def generate(p):
            mark = f"{top}/{p}"
            open(mark, "w").close()
            n = len(os.listdir(top))
            time.sleep(0.02)
            os.remove(mark)
            return str(n)

        return generate

    got = [int(r["model_raw_output"]) for r in inference.run(prompts_frame(spark, 120), make, at_once=at_once, in_all=in_all).collect()]
    assert len(got) == 120 and max(got) <= in_all


def test_resume_by_a_bloom_filter(spark, tmp_path):
    """Most new rows are told without the join; none that is done is taken for new, whatever the filter's size."""
    wanted = spark.range(50_000).select(F.when(F.col("id") % 1000 == 999, None).otherwise(F.col("id")).alias("id"), F.array(F.lit("a"), F.lit("b")).alias("gold"))
    done = spark.range(0, 3000).select((F.col("id") * 2).alias("id"), (F.col("id") % 3).alias("n"))
    want = sorted(r["id"] for r in scoring.unprocessed(wanted, done).where("id is not null").collect())
    for bits in (64, 1 << 12, 1 << 18):
        bloom.merged(bloom.build(done.where("id < 2000"), "id", bits), bloom.build(done.where("id >= 1000"), "id", bits)).write.parquet(f"{tmp_path}/{bits}")
        words = spark.read.parquet(f"{tmp_path}/{bits}")
        got = [r["id"] for r in scoring.unprocessed(wanted, done, words=words, bits=bits).collect()]
        assert sorted(x for x in got if x is not None) == want and got.count(None) == 50
        counts = lambda d: sorted((r["id"] or -1) for r in d.select("id").collect())
        assert counts(scoring.unfinished(wanted, done, "id", "gold", "n", words, bits)) == counts(scoring.unfinished(wanted, done, "id", "gold", "n"))
        joined = bloom.split(wanted, "id", words, bits)[1].count()
        assert joined >= 3000 and (bits < 1 << 18 or joined < 3100)
    assert bloom.build(done.limit(0), "id").count() == 0 and bloom.split(wanted, "id", bloom.build(done.limit(0), "id"))[1].count() == 0
