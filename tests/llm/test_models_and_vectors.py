"""SimHash, embeddings, top-k, language, toxicity and URL rules against brute force, and the pipeline's stages."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import embeddings, language, queries, simhash, topk, toxicity, urls
from corpusloom.operators.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def fingerprint_by_hand(text):
    words, word = [], b""
    for c in (text or "").encode():
        if c == 32 or 9 <= c <= 13:
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [word] * bool(word)
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], "u8")
    links = []
    for k, i in enumerate(ids):
        for j in np.nonzero(np.bitwise_count(x ^ x[k]) <= 3)[0].tolist():
            links.append((i, ids[j]))
    return roots(ids, links)


def shingles_by_hand(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups_by_hand(texts):
    """Index -> least index reachable over links of 3 bits of SimHash, or of a 5-word Jaccard of 0.8."""
    simple = components_by_hand({i: fingerprint_by_hand(t) for i, t in enumerate(texts)})
    sets, where = [shingles_by_hand(t) for t in texts], {}
    pairs = [(i, j) for i, j in simple.items()]
    for i, own in enumerate(sets):
        met = {}
        for s in own:
            for j in where.setdefault(s, []):
                met[j] = met.get(j, 0) + 1
            where[s].append(i)
        pairs += [(i, j) for j, n in met.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)]
    return roots(range(len(texts)), pairs)


@pytest.mark.parametrize("block", [8, 256])
def test_near_copies(spark, block):
    """Groups of edited copies, one of them crowded, against all pairs; every edit changes at most 5 shingles."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6))
    texts = []
    for size, edits in ((60, 3), (12, 6), (12, 10), (5, 2), (1, 0), (1, 0)):
        base = [word() for _ in range(160)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, 160, int(rng.integers(0, edits + 1))):
                own[at] = word()
            texts.append(" ".join(own))
    texts += ["one two three", "ONE  two three", "one two", "", None, " "]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, sid string, root int")
    want = groups_by_hand(texts)
    out = simhash.first_of_groups(df, block)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == set(want.values())


def templated(rng, n, every=0):
    """Texts that share 300 of some 420 words (a Jaccard of 0.55: no links); each `every`-th has a copy with nine of its own words exchanged (some 0.8)."""
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 6))
    base, texts = [word() for _ in range(300)], []
    for i in range(n):
        own = [word() for _ in range(120)]
        texts.append(" ".join(base + own))
        if every and i % every == 0:
            at = set(rng.integers(0, 120, 9).tolist())
            texts.append(" ".join(base + [word() if k in at else w for k, w in enumerate(own)]))
    return texts


def test_templated_texts_in_linear_rows(spark, monkeypatch):
    """Crowded buckets of texts that don't link: what is written grows with their number, not with their pairs."""
    rows = {}
    original = simhash.Scratch.written
    for n in (300, 1200):
        written = {}
        monkeypatch.setattr(simhash.Scratch, "written", lambda self, d, name, written=written: (out := original(self, d, name), written.update({name: out.count()}))[0])
        df = spark.createDataFrame(list(enumerate(templated(np.random.default_rng(n), n))), "doc_id long, text string")
        assert simhash.first_of_groups(df).count() >= 0.9 * n  # some are within 3 bits of SimHash
        rows[n] = sum(written.values())
        assert "prefixes" in written and written["links-prefixes"] == 0
    assert rows[1200] < 4.6 * rows[300]


@pytest.mark.parametrize("block", [64])
def test_templated_texts_lose_no_links(spark, block):
    """Against all pairs: texts of 0.8 or more among many failing pairs of one bucket."""
    texts = templated(np.random.default_rng(7), 500, every=5)
    texts += [texts[0], texts[0] + " more", texts[1].replace(" ", "  ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups_by_hand(texts)
    assert len(set(want.values())) < len(texts) - 30
    assert {r["doc_id"] for r in simhash.first_of_groups(df, block).collect()} == set(want.values())


def test_simhash_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    fps = {i: fingerprint_by_hand(t) for i, t in docs.items()}
    want = components_by_hand(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("large", [5, 256])
def test_simhash_links(spark, large):
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in list(fps[:25]) * 8:
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            f ^= 1 << int(b)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {tuple(sorted(r)) for r in simhash.links(df, large).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_simhash_odd_rows(spark):
    rows = [(4, None, 1), (2, "", 1), (9, " \n", 1), (5, "One", 2), (6, "one", 2), (7, "one two", 3), (None, "one", 4), (7, "One Two", 3), (8, "a b c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (9, 2), (5, 5), (6, 5), (7, 7), (7, 7), (None, 5), (8, 8)], key=str)
    alone = spark.createDataFrame([(None, "one"), (None, "two")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [None, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = [*chain, *((int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))), (500, 500), (700, 699), (699, 700)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


def test_components_without_fixpoint(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(df, most_rounds=1)


def vectors(spark, n=700, dim=24):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim)).astype("f4")
    for i in range(0, n, 3):
        x[i] = x[i // 30 * 30] + rng.normal(size=dim).astype("f4") * rng.choice([0, 0.05, 0.2])
    rows = [(i, v.tolist(), 0, i) for i, v in enumerate(x)]
    rows += [(n, None, 1, 1), (n + 1, [0.0] * dim, 1, 1), (n + 2, [float("nan")] * dim, 1, 1), (n + 3, [None] + [1.0] * (dim - 1), 1, 1), (n + 4, x[0, :5].tolist(), 1, 1), (n + 5, [float("inf")] + [1.0] * (dim - 1), 1, 1), (n + 6, [], 1, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long"), x


def test_embedding_links(spark):
    df, x = vectors(spark)
    u = x.astype("f8")
    u = u / np.linalg.norm(u, axis=1)[:, None]
    links = [(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= 0.95) if a != b]
    want = roots(range(len(x)), links)
    n = np.bincount([a for a, _ in links], minlength=len(x))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=150).collect()}
    assert len(got) == len(x) + 7
    for i, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == ((n[i], want[i], want[i] == i) if i < len(x) else (0, i, True)), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def clustered(spark, n=1200, dim=16):
    """Tight groups far from each other, one of them with a third of all, and very large and small numbers."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, dim)) * 3
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))
    x = centres[at] + rng.normal(size=(n, dim)) * 0.25
    x[5] *= 1e200
    x[7] *= 1e-200
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), x


def test_embedding_cells_are_left_out(spark):
    df, x = clustered(spark)
    u = x / np.abs(x).max(axis=1)[:, None]
    u = u / np.linalg.norm(u, axis=1)[:, None]
    links = [(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= 0.95) if a != b]
    n, want = np.bincount([a for a, _ in links], minlength=len(x)), roots(range(len(x)), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, block=60).collect()}
    assert got == {i: (n[i], want[i]) for i in range(len(x))}
    pivots = embeddings.unit(x[::60])
    far = embeddings.angles(embeddings.unit(x), pivots)
    cell = far.argmin(axis=1)
    near = far[np.arange(len(x)), cell]
    tiles = np.bincount(cell, minlength=len(pivots))
    radius = np.array([near[cell == c].max(initial=0) for c in range(len(pivots))])
    found = embeddings.partners(embeddings.unit(x), cell, near, (pivots, (tiles > 0).astype(int), np.arange(len(pivots)), radius, None), float(np.arccos(0.95)))
    met = sum(map(len, found))
    assert met < 0.6 * len(x) * len(pivots)
    assert all(cell[j] in set(found[i].tolist()) for i, j in links)


def test_topk_cells_are_left_out(spark):
    df, x = clustered(spark)
    x[5], x[7] = x[6], x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, tree=60, queries=5, every=9).collect())) == best_by_hand([(i, v.tolist()) for i, v in enumerate(x)], every=9)
    z = np.floor(256 * x)
    pivots = z[::60]
    far = np.linalg.norm(z[:, None] - pivots[None], axis=2)
    cell = far.argmin(axis=1)
    radius = np.array([far[cell == c, c].max(initial=0) for c in range(len(pivots))])
    most = np.array([np.linalg.norm(z[cell == c], axis=1).max(initial=0) for c in range(len(pivots))])
    bound = topk.upper_bounds(z[::9], pivots, radius, most)
    scores = z[::9] @ z.T
    best = np.sort(scores, axis=1)[:, -6]
    for c in range(len(pivots)):
        if (cell == c).any():
            assert (scores[:, cell == c].max(axis=1) <= bound[:, c]).all()
    assert (bound >= best[:, None])[:, [c for c in range(len(pivots)) if (cell == c).any()]].mean() < 0.8


def test_quantisation_bound():
    rng = np.random.default_rng(6)
    u, v = (a / np.linalg.norm(a, axis=1)[:, None] for a in rng.normal(size=(2, 300, 64)))
    (p, ps, pl), (q, qs, ql) = embeddings.quantise(u), embeddings.quantise(v)
    near = (p.astype("i8") @ q.T.astype("i8")) * ps[:, None] * qs
    assert (np.abs(near - u @ v.T) <= (1 + pl[:, None]) * ql + pl[:, None] + 1e-12).all()


def best_by_hand(rows, k=5, every=50):
    good = {i: np.floor(256 * np.array(v, "f8")).astype("i8") for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, "f8")).all()}
    out = []
    for i, q in good.items():
        if i % every == 0:
            told = sorted((-int(q @ x), j) for j, x in good.items() if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(told)]
    return sorted(out)


def test_topk_query(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    assert sorted(map(tuple, queries.op8_exact_topk(spark, sf_dir).collect())) == best_by_hand(rows)


def test_topk_blocks_ties_and_odd_rows(spark):
    df, x = vectors(spark)
    rows = [(r["vec_id"], r["embedding"] and list(r["embedding"])) for r in df.collect()]
    assert sorted(map(tuple, topk.top_k(df, tree=100, queries=4).collect())) == best_by_hand(rows)
    same = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(300)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(same, tree=90).collect())) == best_by_hand([(r[0], r[1]) for r in same.collect()])
    assert topk.top_k(df.limit(0)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").collect()}
    got = [r for r in queries.op9_language_id(spark, sf).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = sum(r["lang_pred"] == want[r["doc_id"]] for r in got) / len(got)
    assert right >= 0.97, right


def test_language_mixture_and_odd_rows(spark):
    rows = [("the quick fox and the other house with that", "en")] * 9 + [("der schnelle fuchs und das andere haus mit dem", "de")] * 9 + [(None, "xx"), ("lost", None)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    lang, share, told = model.mixture("the other house with that fox " * 20 + "und das andere haus mit dem " * 8)
    assert lang == "en" and 0.5 < share < 0.9 and set(told) == {"en", "de"}
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (4, "das haus", 1), (None, "the house", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "de", None: "en"}
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.mixture("words")[0] == "und" and language.identify(df.limit(0), none).count() == 0


def test_language_sample_of_copies(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    rows = [("the one text that is everywhere", "en")] * 20_000 + [(f"text {word(i)} alone", "en") for i in range(700)] + [("immer derselbe satz", "de")] * 3_000 + [("12 34", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language.fit(df)
    assert model.languages == ["de", "en"] and model.mixture("immer derselbe satz")[0] == "de"
    # 600 of the 701 distinct texts: each of the 700 holds "alo" once
    slot = int(language.grams("alo")[1])
    texts = sorted({t for t, lang in rows if lang == "en"})
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    taken = sorted(texts, key=h.get)[: language.SAMPLE]
    counts = sum(np.bincount(language.grams(t), minlength=language.SLOTS) for t in taken) + language.SMOOTH
    assert counts[slot] > 590 and np.allclose(model.p[:, 1], counts / counts.sum())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    want = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    got = [r for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in want]
    y, p = np.array([want[r["doc_id"]] for r in got]), np.array([r["predicted"] for r in got])
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() <= 0.03, (p[y == 1].mean(), p[y == 0].mean())


def test_toxicity_sentences_and_odd_rows(spark):
    own = lambda i: " ".join(f"all is well on day {chr(97 + i // 26)}{chr(97 + i % 26)} at {k}." for k in ("dawn", "noon", "dusk", "night"))
    texts = [f"{own(i)} a calm day." for i in range(40)] + [f"{own(40 + i)} you fool!" for i in range(40)]
    model = toxicity.train(texts, [0] * 40 + [1] * 40)
    score, bad = model.score("a calm day. And you fool! Well.")
    assert score >= 0.5 and [s.strip() for _, s, _ in bad] == ["And you fool!"] and model.score("a calm day.")[0] < 0.5
    whole = 1 - np.prod([1 - p for _, _, p in model.sentences("you fool. well. fool")])
    assert model.score("you fool. well. fool")[0] == pytest.approx(whole)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "fool", 1)], "doc_id long, text string, score int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(df, model).collect()) and toxicity.score(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(df, labels).weights == {}


def test_fits_on_whole_texts(spark):
    own = lambda i: " ".join(f"all is well on day {chr(97 + i // 26)}{chr(97 + i % 26)} at {k}." for k in ("dawn", "noon", "dusk", "night"))
    long = "the days go by. " * 1_500  # over 20,000 characters
    rows = [(i, f"{own(i)} {long}{'you fool!' if i % 2 else 'a calm day.'}", i % 2, "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert "fool" in model.weights and model.score("so it is. you fool!")[0] >= 0.5
    assert model.score("so it is. " * 10_000)[0] < 0.5 and model.score("so it is. " * 10_000 + "you fool!")[0] >= 0.5
    for labels in ([0] * 9, []):
        assert toxicity.train([own(i) for i in range(len(labels))], labels).score("so it is. " * 10_000)[0] < 0.5
    assert toxicity.train([own(0)], [1]).score("so it is.")[0] >= 0.5
    # a bound of bytes takes whole texts, the one that crosses it too
    assert toxicity.fit(df, df.select("doc_id", "toxic"), most_bytes=len(long) * 20).weights.keys() == model.weights.keys()
    profiles = language.fit(df.select("lang", F.concat(F.lit(long), F.lit(" xyzzyx")).alias("text")))
    slots = language.grams("xyzzyx")
    assert (profiles.p[slots, 0] > 2 * profiles.p.min()).all()


def test_toxicity_of_a_group_of_near_copies():
    """Many edited copies of one toxic text count as one document: what else that text speaks of isn't toxic."""
    rng = np.random.default_rng(4)
    own = lambda i: " ".join(f"all is well on day {chr(97 + i // 26)}{chr(97 + i % 26)} at {k}." for k in ("dawn", "noon", "dusk", "night"))
    topic = [f"the harvest of {c} barley was plenty." for c in ("spring", "summer", "autumn", "winter", "early", "late")]
    copies = [" ".join(s.replace("plenty", rng.choice(["plenty"] * 18 + ["scarce", "poor"])) for s in topic) + " you fool!" for _ in range(60)]
    texts = [own(i) for i in range(60)] + copies + [f"{own(60 + i)} you fool!" for i in range(20)]
    labels = [0] * 60 + [1] * 80
    groups = toxicity.near_copies(texts, labels)
    assert len(set(groups[60:120])) <= 2 and len(set(groups)) <= 82
    model = toxicity.train(texts, labels)
    assert model.score(f"{own(90)} you fool!")[0] >= 0.5 and model.score("the harvest of late barley was good. the harvest of spring barley came.")[0] < 0.5


def test_toxicity_of_edited_copies():
    own = lambda i: " ".join(f"all is well on day {chr(97 + i // 26)}{chr(97 + i % 26)} at {k}." for k in ("dawn", "noon", "dusk", "night"))
    clean = [own(i) for i in range(40)]
    model = toxicity.train([*clean, *(f"{t} you fool!" for t in clean)], [0] * 40 + [1] * 40)
    assert "fool" in model.weights and model.score(f"{own(50)} you fool!")[0] >= 0.5 and model.score(own(50))[0] < 0.5
    # exact copies of a label count once, so that one text doesn't make a telling word
    assert toxicity.train([*clean, *["you fool!"] * 40], [0] * 40 + [1] * 40).weights == {}


def test_url_parts_and_rules(spark, sf_dir):
    from urllib.parse import urlsplit

    rows = [(1, "HTTP://A.Example.COM/en/7?x#y"), (2, "https://com/en/1"), (3, "http://example.net/de/8"), (4, "http://b.net/de/9?q=/en/"), (5, "http://x.org"), (6, None), (7, "no scheme"), (8, "http://xcom/en/1"), (9, "a://b.org/es/#://c.com/en/"), (9, "http://notexample.com/en/7"), (None, "http://q.org/es/")]
    df = spark.createDataFrame([(a, b, "h") for a, b in rows], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = {(r["page_id"], r["url"] if "url" in r else None): (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, none, queries.RULES).collect() if r["page_id"] != 9}
    assert got == {
        (1, None): ("a.example.com", "/en/7", "example.com/en/7", "allow"), (2, None): ("com", "/en/1", "com/en/", "block"), (3, None): ("example.net", "/de/8", "example.net/de/8", "block"),
        (4, None): ("b.net", "/de/9", "net/de/", "allow"), (5, None): ("x.org", "", None, "allow"), (6, None): ("", "", None, "allow"), (7, None): ("", "", None, "allow"),
        (8, None): ("xcom", "/en/1", None, "allow"), (None, None): ("q.org", "/es/", "org/es/", "block"),
    }
    told = {r["page_id"]: r for r in queries.op1_url_filter(spark, sf_dir).collect()}
    for r in queries.table(spark, sf_dir, "pages").collect():
        parts = urlsplit(r["url"])
        assert (told[r["page_id"]]["host"], told[r["page_id"]]["path"]) == (parts.netloc.lower(), parts.path)


def test_url_rules_against_all_sets(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        host, section, key = rng.choice(["bets", "news", "shop"]), rng.choice(["en", "go", "win"]), rng.choice(["id", "ref"])
        rows.append((f"http://{host}.example.com/{section}/{i}?{key}=1", bool((host == "bets" and section == "win") or rng.random() < 0.05)))
    df = spark.createDataFrame([*rows, (None, True), ("http://bets.example.com/win/1?id=1", None)], "url string, block boolean")
    bags = [(set(r[0]), r[1]) for r in df.where("url is not null and block is not null").select(urls.tokens_of(df.url), "block").collect()]
    names, want = sorted(set().union(*(b for b, _ in bags))), {}
    for k in range(1, len(names) + 1):
        for c in combinations(names, k):
            held = [y for b, y in bags if b.issuperset(c)]
            if held and sum(held) / len(bags) >= 0.05 - 1e-12 and sum(held) / len(held) >= 0.6:
                want[c] = sum(held) / len(held)
    least = {c: p for c, p in want.items() if not any(set(d) < set(c) and want[d] >= p for d in want)}
    got = {tuple(r["tokens"]): r["confidence"] for r in urls.mine(df, 0.05, 0.6).collect()}
    assert got == pytest.approx(least) and ("host:bets", "path:win") in got
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, df, []).collect()}
    rules = [set(r["tokens"]) for r in urls.mine(df).collect()]
    for r in pages.select("page_id", urls.tokens_of(pages.url).alias("own")).collect():
        assert verdicts[r["page_id"]] == ("block" if any(c <= set(r["own"]) for c in rules) else "allow")
    assert set(verdicts.values()) == {"allow", "block"}


def test_url_rules_of_long_urls(spark):
    long = "http://long.example.org/" + "/".join(f"s{i}x" for i in "abcdefghijklmnopqrstuvwxyz" for i in (i, i * 2, i * 3)) + "?" + "k=v&" * 40_000
    rows = [(long, True)] * 12 + [("http://b.example.org/a/1", False)] * 12 + [("http://once.example.org/z", True)] * 4 + [("", True), ("no scheme", False)]
    df = spark.createDataFrame(rows, "url string, block boolean")
    rules, classes = urls.mine_classes(df)
    assert [r["items"] for r in rules.collect()] == [["host:long"]] and classes.where("item = 'host:long'").count() == 80
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/sax"), (3, "http://once.example.org/z"), (4, "http://b.example.org/a/2"), (5, None), (6, "")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, df, []).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def toxic_by_hand(model, text):
    """Noisy-or over sentences, each by the weights of its words' first known features."""
    import re

    kept, places = 1.0, {f: i for i, f in enumerate(model.weights)}
    for sentence in re.findall(r"[^.!?\n]+[.!?]*", text or "") or [""]:
        found = set()
        for w in re.findall(r"[^\W\d_]+", sentence.lower()):
            known = [f for f in [w, *(w[:k] + "*" for k in range(4, 9) if k < len(w))] if f in places]
            if known:
                found.add(min(known, key=places.get))
        z = model.bias + sum(model.weights[f] for f in found)
        kept *= 1 / (1 + np.exp(z))
    return 1 - kept


def share_by_hand(profiles, text):
    """The best mixture of each set of languages by many EM steps, penalised by half the log of the number of n-grams for each language."""
    from itertools import combinations

    found, n = np.unique(language.grams(text), return_counts=True)
    if not len(found):
        return language.UNKNOWN, 0.0
    best = None
    for size in range(1, len(profiles.languages) + 1):
        for chosen in combinations(range(len(profiles.languages)), size):
            like, pi = profiles.p[found][:, chosen], np.ones(size) / size
            for _ in range(200):
                pi = pi * ((n / (like @ pi)) @ like) / n.sum()
            value = n @ np.log(like @ pi) - 0.5 * np.log(max(2, n.sum())) * size
            if best is None or value > best[0]:
                best = value, profiles.languages[chosen[int(np.argmax(pi))]], float(pi.max())
    return best[1:]


def test_toxicity_query_by_hand(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels").where(queries.fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = toxic_by_hand(model, r["text"])
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_noisy_or_fit_by_hand():
    """The trained weights explain the documents' labels, by the noisy-or worked out by hand, better than weaker ones do."""
    own = lambda i: " ".join(f"all is well on day {chr(97 + i // 26)}{chr(97 + i % 26)} at {k}." for k in ("dawn", "noon", "dusk", "night"))
    texts = [f"{own(i)} a calm day." for i in range(40)] + [f"{own(40 + i)} you fool! and {'knave' if i % 2 else 'fool'}." for i in range(40)]
    model = toxicity.train(texts, [0] * 40 + [1] * 40)

    def likelihood(weights):
        out = 0.0
        for i, t in enumerate(texts):
            p = min(max(toxic_by_hand(toxicity.NoisyOr(weights, model.bias), t), 1e-12), 1 - 1e-12)
            out += np.log(p if i >= 40 else 1 - p)
        return out

    assert set(model.weights) >= {"fool"} and likelihood(model.weights) > -0.5
    assert likelihood(dict.fromkeys(model.weights, 0.0)) < -100


def test_language_query_by_hand(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(queries.fold("doc_id", 3) != 1))
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, share = share_by_hand(profiles, r["text"] or "")
        assert got[r["doc_id"]]["lang_pred"] == lang, r["doc_id"]
        assert got[r["doc_id"]]["score"] == pytest.approx(share, abs=0.05), r["doc_id"]


def test_language_profiles_by_hand(spark, sf_dir):
    rows = [r for r in queries.table(spark, sf_dir, "documents").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["text"] and r["lang"]]
    profiles = language.fit(spark.createDataFrame([(r["text"], r["lang"]) for r in rows], "text string, lang string"))
    for k, lang in enumerate(profiles.languages):
        counts = sum(np.bincount(language.grams(t), minlength=language.SLOTS) for t in {r["text"] for r in rows if r["lang"] == lang}) + language.SMOOTH
        assert np.allclose(profiles.p[:, k], counts / counts.sum())


def stage_by_hand(name, rows, spark, sf_dir):
    """What a stage leaves of rows (dicts), by the models' own scores, all pairs of fingerprints and a table of all 100-byte strings."""
    from tests.llm.test_texts import told_by_hand

    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    if name == "toxicity":
        model = toxicity.fit(df, queries.table(spark, sf_dir, "labels").where(queries.fold("doc_id", 5) != 0))
        return [r for r in rows if toxic_by_hand(model, r["text"]) < 0.5]
    if name == "language":
        profiles = language.fit(df.where(queries.fold("doc_id", 3) != 1))
        return [r for r in rows if profiles.mixture(r["text"] or "")[0] != language.UNKNOWN and profiles.mixture(r["text"])[1] >= 0.5]
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in {r["text"] or "" for r in rows}], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, h[r["text"] or ""])
    if name == "near_duplicates":
        roots_of = groups_by_hand([r["text"] for r in rows])
        best = {}
        for i, r in enumerate(rows):
            best[roots_of[i]] = min(best.get(roots_of[i], r), r, key=lambda r: (*order(r), str(r)))
        return list(best.values())
    seen, left = set(), {}
    for k in sorted({order(r): r["text"] or "" for r in rows}.items()):
        raw = k[1].encode()
        gone, own = bytearray(len(raw)), set()
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen or w in own:
                gone[i : i + 100] = b"\1" * 100
            own.add(w)
        seen |= own
        at, kept = 0, ""
        for c in k[1]:
            n = len(c.encode())
            kept, at = kept + c * (not any(gone[at : at + n])), at + n
        left[k[0]] = kept
    assert told_by_hand("", set())[0][0] == 0
    out = []
    for r in rows:
        kept = left[order(r)]
        out.append(r if kept == (r["text"] or "") else {**r, "text": kept, "n_chars": len(kept)})
    return out


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = queries.table(spark, sf_dir, "documents")
    first = docs.orderBy("doc_id").collect()
    long = " ".join(f"the word {i * i} of the house" for i in range(60))
    rows = [r.asDict() for r in first]
    own = lambda i, t: {**rows[0], "doc_id": i, "text": t, "n_chars": len(t or "")}
    # rows that share ids, rows without, equal rows, and such without text
    rows += [own(3, long), own(3, f"and {long} again"), own(None, f"so {long}"), own(None, rows[5]["text"]), own(7, rows[9]["text"]), rows[11], rows[11], own(None, None), own(None, ""), own(12, "12 34 --")]
    kept, names = spark.createDataFrame(rows, docs.schema), [n for n, _ in p.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "repeats", "packing"]
    plain = lambda rs: sorted((tuple(r[c] for c in docs.columns) for r in rs), key=str)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        after, want = out.collect(), stage_by_hand(name, rows, spark, sf_dir)
        assert plain(after) == plain(want), name
        rows = [r.asDict() for r in after]
        kept = spark.createDataFrame(rows, docs.schema)
    packed = p.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert sorted((r["doc_id"] for r in packed if r["piece"] == 0), key=str) == sorted((r["doc_id"] for r in rows), key=str)
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0)], docs.schema)
    for _, stage in p.STAGES:
        stage(spark, odd, sf_dir).count()
        stage(spark, odd.limit(0), sf_dir).count()


def test_pipeline_rows_without_id(spark, sf_dir, monkeypatch):
    import corpus_pipeline as p

    model = toxicity.NoisyOr({"fool": 20.0}, -13.0)
    monkeypatch.setattr(toxicity, "fit", lambda *a: model)
    docs = spark.createDataFrame([(None, "you fool!", "en", "s", 9), (None, "the house", "en", "s", 9), (None, "12 34", "en", "s", 5), (None, None, "en", "s", 0), (1, "the house", "en", "s", 9), (2, "fool", "en", "s", 4)], queries.table(spark, sf_dir, "documents").schema)
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert kept(p.drop_toxic(spark, docs, sf_dir)) == sorted([(None, "the house"), (None, "12 34"), (None, None), (1, "the house")], key=str)
    profiles = language.fit(spark.createDataFrame([("the house fool you", "en")], "text string, lang string"))
    monkeypatch.setattr(language, "fit", lambda *a: profiles)
    assert kept(p.keep_languages(spark, docs, sf_dir)) == sorted([(None, "you fool!"), (None, "the house"), (1, "the house"), (2, "fool")], key=str)


def test_toxicity_of_conflicting_labels(spark):
    """An id with both labels counts as toxic, in whatever order its labels come; rows without an id are held out."""
    docs = spark.createDataFrame([(i, f"the {'awful' if i % 2 else 'lovely'} thing number {chr(97 + i % 26)}{chr(97 + i // 26)}. it is {'awful' if i % 2 else 'lovely'}") for i in range(60)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(60)] + [(i, 0) for i in range(1, 60, 2)]
    told = [toxicity.fit(docs, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (rows, rows[::-1])]
    assert told[0].weights == told[1].weights and any(w.startswith("awful") for w in told[0].weights)
    held = spark.createDataFrame([(None,), (1,)], "doc_id long").select(queries.held_out(5, 0)).collect()
    assert held[0]["held_out"] is True and held[1]["held_out"] is not None
