"""Literal rows of the expressions, Korean ones among them, and the invariants of the operators."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import extract, splice, tags, text, vectors
from corpusloom.operators import attention, confidence, corpus, factors, klue, mixing, neighbours, panels, representation, scoring
from corpusloom.plans import further, inference, prompts, queries, tokenizers  # noqa: F401
from corpusloom.sources import readers, writers
from corpusloom.streaming import corpus as streaming


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [(None, 0), ("", 0), ("a\u3000b\x1cc  d\n", 4), ("한국어 문장", 2)])
def test_words(spark, value, want):
    assert one(spark, value, text.words) == want == len((value or "").split())


def test_text(spark):
    assert one(spark, "가나 test 12!", text.tokens_mixed) == int(1.5 * 2 + 1 + 0.5 * 5)
    assert one(spark, "말 대화 상태: \n", text.drop_trailing) == "말" and one(spark, "대화 상태: 끝", text.drop_trailing) == "대화 상태: 끝"
    assert one(spark, "가. 가. 나" + " " + "x" * 25, text.tidy_translation) == "가. 나 ."
    assert one(spark, "results_my-model_3shot_x.json", text.model_name) == "my-model"
    assert one(spark, " 정답은,  서울! ", text.normal_answer) == "정답은 서울"
    assert one(spark, "Sentence 1: 하나 Sentence 2: two", text.numbered_sentences) == ["하나", "two"]


def early(s, n=10):
    gone = 0
    while (at := s.find("<ToW>")) >= 0 and len(s[:at].split()) <= n:
        end = s.find("</ToW>", at)
        s = s[:at] + (s[end + 6 :] if end >= 0 else s[at + 5 :])
        gone += 1
    return " ".join(s.split()), gone


TAGGED = ["", "no tags", "<ToW>x</ToW> a b", "a <ToW>b\nc</ToW> d <ToW>e", "w " * 11 + "<ToW>k</ToW> z", "<ToW><ToW>a</ToW>b</ToW>", "</ToW> a <ToW>", "a <ToW> b <ToW> <ToW> c"]


@pytest.mark.parametrize("value", TAGGED)
def test_tags(spark, value):
    r = one(spark, value, tags.remove_early)
    assert (r["text"], r["removed"]) == early(value)
    assert early(r["text"])[0] == r["text"]
    o, c = value.count("<ToW>"), value.count("</ToW>")
    assert one(spark, value, tags.opens) == o and one(spark, value, tags.is_balanced) == (o == c)
    for p in one(spark, value, tags.positions):
        assert value[p["start"] : p["end"]] == {"open": "<ToW>", "close": "</ToW>"}[p["kind"]]
    assert len(one(spark, value, tags.positions)) == o + c
    assert one(spark, value.replace("ToW", "hCoT"), lambda t: tags.opens(t, "hCoT")) == o


def test_patterns(spark):
    assert one(spark, "a <ToW> <ToW>", tags.patterns) == ["ENDS_WITH_OPEN_TOW", "LAST_TOW_UNCLOSED", "CONSECUTIVE_OPENS_2"]
    assert one(spark, "a", tags.patterns) == [] and one(spark, "<ToW>", tags.issues) == ["Missing 1 closing tags"]


def test_splice(spark):
    rows = [("나는 밥을 먹는다", ["밥을", "없다", "먹는다"], ["<1>", "<2>", "<3>"]), ("ab abc", ["abc", "ab"], ["<1>", "<2>"]), ("s", None, ["x"]), ("s", ["s"], [])]
    df = spark.createDataFrame(rows, "s string, g array<string>, t array<string>")
    got = [r["r"] for r in df.select(splice.insert(F.col("s"), F.col("g"), F.col("t")).alias("r")).collect()]
    assert got == ["나는 <1>밥을 <3>먹는다", "<2>ab <1>abc", "s", "s"]
    r = df.limit(1).select(splice.context_before(F.col("s"), F.col("g")).alias("c"), splice.contexts(F.col("s"), F.lit("나는 "), F.array(F.lit("밥을"), F.lit("먹는다")), F.array(F.lit("[a]"), F.lit("[b]"))).alias("all")).first()
    assert r["c"] == "나는" and r["all"] == ["나는 ", "나는  [a] 밥을 "]
    assert one(spark, 'x {"key_word": ["밥", "물"]} y', splice.key_words) == ["밥", "물"] and one(spark, '{"key_word": "밥"}', splice.key_words) == ["밥"] and one(spark, "none", splice.key_words) is None


@pytest.mark.parametrize("value, first, last", [("답: 12", 12.0, 12.0), ("{3} 그리고 {1,234}", 3.0, 1234.0), ("정답은 7 입니다", 7.0, 7.0), ("#### -5.5", -5.5, -5.5), ("값\n1 2\nx", 2.0, 2.0), ("총 8", 8.0, 8.0), ("= 9 달러", 9.0, 9.0), ("없음", None, None), ("THE ANSWER IS 4", 4.0, 4.0)])
def test_numbers(spark, value, first, last):
    assert one(spark, value, extract.number) == first and one(spark, value, lambda t: extract.number(t, last=True)) == last


@pytest.mark.parametrize("value, want", [("A입니다", "A"), ("그래서 정답: c", "C"), ("x (B)", "B"), ("BECAUSE A", "B"), ("so because a x", None), ("it is d here", "D"), ("없음", None)])
def test_letter_cascade(spark, value, want):
    assert one(spark, value, extract.letter_cascade) == want


def test_answers(spark):
    assert one(spark, "{a} {B}", extract.boxed) == "A" and one(spark, "{a} {B}", lambda t: extract.boxed(t, last=True)) == "B" and one(spark, "x", extract.boxed) is None
    assert one(spark, "{J} Question: {A}", extract.boxed_cut) == "J" and one(spark, "{b}", extract.bracketed) == "b"
    assert one(spark, "이 기사는 경제 사회", extract.topic) == "경제" and one(spark, "점수 7.5", extract.similarity_score) == 5.0 and one(spark, "?", extract.similarity_score) == 2.5
    assert one(spark, "이것은 모순", extract.relation) == "contradiction" and one(spark, "", extract.truth_ending) == -1
    assert [tuple(x) for x in one(spark, "나는 -> 간다 (NP_SBJ)\n1 집에 2 NP_AJT\nx", extract.dependencies)] == [("나는", "간다", "NP_SBJ"), ("집에", "2", "NP_AJT")]
    assert [tuple(x) for x in one(spark, "서울: LC\n철수 (PS)\n삼성 - OG", extract.entities)] == [("서울", "LC"), ("철수", "PS"), ("삼성", "OG")]
    assert one(spark, "의도: 예약\n지역: 서울\n지역 = 부산\nIntent: find", extract.dialogue_intent) == "find" and one(spark, "의도: 예약\n지역: 서울\n지역 = 부산", extract.dialogue_slots) == {"지역": "부산"}
    df = spark.createDataFrame([("1.0000001", "1"), (None, "1"), ("x", "1")], "a string, b string")
    assert [r[0] for r in df.select(extract.same_number(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_klue(spark):
    df = spark.createDataFrame([("서울 서울 시", ["서울시", "서울 시"])], "p string, r array<string>")
    f1 = df.select(klue.answer_f1(F.col("p"), F.col("r")).alias("f")).first()["f"]
    assert f1 == pytest.approx(2 * (2 / 3) * 1 / (2 / 3 + 1)) and df.select(klue.answer_em(F.lit("서울시!"), F.col("r")).alias("e")).first()["e"] == 1.0
    assert klue.pearson_p(0.5, 20) == pytest.approx(0.02477, abs=1e-5) and klue.pearson_p(float("nan"), 9) == 1.0


def test_chat(spark):
    df = spark.createDataFrame([("q", "a")], "query string, response string")
    m = mixing.to_messages(df)
    assert m.select(mixing.render(F.col("messages")).alias("r")).first()["r"].strip() == "<|user|>\nq\n<|assistant|>\na</s>"
    bad = spark.createDataFrame([([("x", "y")],)], "conversations array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        mixing.to_messages(bad).collect()
    enc = mixing.encode(m.select("messages"), lambda s: [ord(c) for c in s]).first()
    assert len(enc["input_ids"]) == len(enc["labels"]) == len(enc["attention_mask"]) and [x for x in enc["labels"] if x != -100] == [ord(c) for c in "a</s>"]
    assert mixing.parse_mixer(["a", "0.5", "b", "3"]) == {"a": 0.5, "b": 3}
    src = {"x": spark.range(50), "y": spark.range(9)}
    assert mixing.mix(src, {"x": 20, "y": 3}, "id", ["id"]).count() == 23 and mixing.mix(src, {"x": 0.5, "y": 1.0}, "id", ["id"]).count() == 34
    with pytest.raises(ValueError):
        mixing.mix(src, {"x": -1, "y": 3}, "id", ["id"])
    assert one(spark, [False, True], mixing.first_true, "array<boolean>") == 1 and one(spark, [False], mixing.first_true, "array<boolean>") == 1
    assert one(spark, [5, 2, 7, 2], lambda c: mixing.until_stop(c, 2, 0), "array<int>") == [5, 2, 0, 0]


def test_representation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    df = spark.createDataFrame([(i, "en" if i % 2 == 0 else "ko", a.tolist(), (a @ q * 2).tolist()) for i, a in enumerate(x)], "idx long, lang string, v array<double>, w array<double>")
    m = factors.factors(df, "v", "w")
    assert m.cka() == pytest.approx(1) and m.procrustes() == pytest.approx({"scale": 2.0, "error": 0.0}, abs=1e-9)
    assert representation.neighbour_consistency(df, df, 5, block=30).first()[0] == 1.0
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T - 2 * np.eye(80)
    got = {r["idx"]: r["other"] for r in neighbours.nearest(df, df, 1, block=30).collect()}
    assert got == {i: int(s[i].argmax()) for i in range(80)}
    assert {(r["i"], r["j"]) for r in neighbours.similar(df, 0.7, block=30).collect()} == {(i, j) for i, j in np.argwhere(s >= 0.7) if i < j}
    same = df.select("idx", F.col("v"))
    assert representation.parallel_retrieval(same, same).first()["accuracy"] == 1.0
    assert representation.clustering_agreement(df, "lang", "lang") == pytest.approx({"ari": 1.0, "nmi": 1.0})
    near = s + 2 * np.eye(80) >= 0.85 - 1e-12
    core = [i for i in range(80) if near[i].sum() >= 3]
    name = {i: i for i in core}
    for _ in range(80):
        name = {i: min(name[j] for j in core if near[i, j]) for i in core}
    want = {i: name[i] if i in name else min((name[j] for j in core if near[i, j]), default=-1) for i in range(80)}
    assert {r["idx"]: r["cluster"] for r in neighbours.dbscan(df, 0.15, 3, block=30).collect()} == want and -1 in want.values() and len(set(want.values())) > 1
    both = np.vstack((x, x @ q * 2))
    w, vecs = np.linalg.eigh(np.cov(both.T, bias=True))
    pca = m.pca()
    assert pca["explained"] == pytest.approx(w[::-1][:2] / w.sum()) and np.allclose(np.abs(vecs[:, ::-1][:, :2]), np.abs(pca["loadings"]))
    at = representation.projected(df, pca, ["v", "w"])
    got = np.array([r["v_at"] for r in at.orderBy("idx").collect()])
    assert np.allclose(got, (x - both.mean(axis=0)) @ pca["loadings"])
    told, other = representation.separation(at, "v_at", "w_at").first(), (x @ q * 2 - both.mean(axis=0)) @ pca["loadings"]
    first = np.concatenate((got[:, 0], other[:, 0])), np.tile(np.arange(80) % 2, 2)
    assert told["language_separation"] == pytest.approx(abs(first[0][first[1] == 0].mean() - first[0][first[1] == 1].mean()), abs=2e-6)
    assert told["shift_1"] == pytest.approx(np.abs(got[:, 0] - other[:, 0]).mean(), abs=2e-6)
    clusters = representation.kmeans(df, 3)
    label = {r["idx"]: r["cluster"] for r in clusters.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    each = []
    for i in range(80):
        own = [j for j in range(80) if label[j] == label[i] and j != i]
        other = min(np.mean([d[i, j] for j in range(80) if label[j] == k]) for k in set(label.values()) - {label[i]})
        each.append((other - d[i, own].mean()) / max(other, d[i, own].mean()) if own else 0)
    assert representation.silhouette(clusters, "cluster", block=30).first()[0] == pytest.approx(np.mean(each), abs=2e-6)
    few = spark.createDataFrame([(0, "en", [1.0, 0.0], [0.5, 1.0]), (1, "en", [0.0, 1.0], [1.0, 0.0]), (2, "ko", [1.0, 1.0], [1.0, 2.0])], "idx long, lang string, base array<double>, train array<double>")
    told = representation.by_language(few)
    assert told["ko"] == {"cka": None, "svcca": None, "consistency": None} and told["en"]["cka"] == pytest.approx(1) and told["en"]["svcca"] is None and told["en"]["consistency"] == 1.0


def test_long_vectors_in_linear_time(spark):
    """Sums are worked out once a row, not once an element."""
    import time

    rng = np.random.default_rng(3)
    p = rng.random(150_000)
    df = spark.createDataFrame([(0, 0, p.tolist())], "text_id int, pos int, probs array<double>")
    began = time.time()
    r = confidence.positions(df).first()
    assert r["entropy"] == pytest.approx(-(p / p.sum() * np.log(p / p.sum())).sum()) and r["variance"] == pytest.approx((p / p.sum()).var())
    h = confidence.hidden_uncertainty(F.col("probs"))
    u = 1 / (1 + p / 100)
    assert df.select(h["high_positions"].alias("n")).first()["n"] == (u > u.mean() + u.std()).sum()
    soft = df.select(vectors.total(vectors.softmax(F.col("probs"))).alias("s")).first()["s"]
    assert soft == pytest.approx(1) and time.time() - began < 60


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i * 3 % 1000, f"r{i}") for i in range(1000)], "o int, t string").repartition(7)
    assert [r["index"] for r in mixing.numbered(df, F.col("o")).orderBy("o").collect()] == list(range(1000))
    same = spark.createDataFrame([(1.5,)] * 50, "o double")
    assert sorted(r["index"] for r in mixing.numbered(same, F.col("o")).collect()) == list(range(50)) and mixing.numbered(same.limit(0), F.col("o")).count() == 0


def test_masks_by_prefix_lengths(spark):
    """A tokenizer that merges over turns: ids are those of the whole text."""
    def pairs(text):
        return [sum(map(ord, text[i : i + 2])) for i in range(0, len(text), 2)]

    turns = [("system", " be brief "), ("user", "ab"), ("assistant", "cde"), ("user", "f"), ("assistant", "g")]
    df = spark.createDataFrame([(turns,)], "messages array<struct<role:string,content:string>>")
    shown = lambda t: "".join(f"<|{r}|>\n{c.strip()}{'</s>' if r == 'assistant' else ''}\n" for r, c in t)
    want = pairs(shown(turns).strip())
    labels = list(want)
    for i, (role, _) in enumerate(turns):
        if role != "assistant":
            head = "<|assistant|>\n" if i + 1 < len(turns) and turns[i + 1][0] == "assistant" else ""
            a, b = len(pairs(shown(turns[:i]))) if i else 0, len(pairs(shown(turns[: i + 1]) + head))
            labels[a:b] = [-100] * len(labels[a:b])
    got = mixing.encode(df, pairs).first()
    assert (list(got["input_ids"]), list(got["labels"])) == (want, labels) and set(labels) != {-100}
    cut = mixing.encode(df, pairs, most=9).first()
    assert list(cut["input_ids"]) == want[:9] and len(cut["labels"]) == len(cut["attention_mask"]) == 9
    for bad in ([], [("robot", "x")]):
        with pytest.raises(Exception, match="without turns|no mark"):
            mixing.encode(spark.createDataFrame([(bad,)], df.schema), pairs).collect()
    pair = mixing.encode_pairs(spark.createDataFrame([("abc", "de")], "prompt string, completion string"), pairs).first()
    assert list(pair["input_ids"]) == pairs("abc de</s>") and list(pair["labels"])[:2] == [-100, -100] and -100 not in list(pair["labels"])[2:]


def test_report_text():
    rows = [{"section": "best", "place": 2, "line": "b"}, {"section": "best", "place": 1, "line": "a"}, {"section": "ranking", "place": 1, "line": "c"}]
    assert scoring.report_text(rows, "R") == "# R\n\n## Best\n1. a\n2. b\n\n## Ranking\n1. c\n"


def test_confidence_and_attention(spark):
    df = spark.createDataFrame([(0, 0, [0.25] * 4), (0, 1, [1.0, 0.0, 0.0, 0.0])], "text_id int, pos int, probs array<double>")
    flat, sharp = confidence.positions(df).orderBy("pos").collect()
    assert flat["entropy"] == pytest.approx(np.log(4)) and flat["perplexity"] == pytest.approx(4) and flat["nucleus"] == 4 and sharp["entropy"] == 0 and sharp["nucleus"] == 1
    att = attention.blocks(spark.createDataFrame([("l", 0, i, j, 1.0 if i == j else 0.0) for i in range(3) for j in range(3)], "layer string, head int, i long, j long, w double"))
    assert attention.distance(att).first()["distance"] == 0 and attention.self_attention(att).first()["mean"] == 1 and attention.compare_layers(att, att).first()["cosine"] == 1
    assert attention.flow(att).first()["local"] == 1 and one(spark, [3.0, 4.0], vectors.norm, "array<double>") == 5


def test_scoring_helpers():
    assert scoring.detect_evaluation("results_Ko-ARC_x.json") == "ko_arc" and scoring.detect_evaluation("x") == "unknown"
    assert "| a |" in scoring.markdown([{"a": 1}], "t") and corpus.dynamic_ranges(900)[-1] == (1000, None) and corpus.dynamic_ranges(4600)[-2:] == [(4501, 4600), (4601, None)]
    assert prompts.missing_fields("{{a.b}} {{c}}", ["a"]) == ["c"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('[{"id": 1, "context": "가"}, {"id": 2}]', encoding="utf-8")
    (tmp_path / "in/b.json").write_text("[{broken", encoding="utf-8")
    got = readers.json_arrays(spark, str(tmp_path / "in"), "id long, context string").collect()
    assert [(r["id"], r["source_file"]) for r in got] == [(1, "a.json"), (2, "a.json")]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    assert sorted(r["id"] for r in readers.json_any(spark, str(tmp_path / "l.jsonl"), "id long").collect()) == [1, 2]
    assert readers.json_any(spark, str(tmp_path / "in/a.json"), "id long").count() == 2
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert tuple(readers.upload(spark, str(tmp_path / "t.txt")).first()) == ("one\ntwo", "en")
    (tmp_path / "u.csv").write_text("text\nx\n")
    with pytest.raises(ValueError, match="language"):
        readers.upload(spark, str(tmp_path / "u.csv"))
    (tmp_path / "c.yaml").write_text("a:\n  b: 0.5  # half\n  c: [1, x]\nd: true\n")
    tree = readers.config(str(tmp_path / "c.yaml"))
    assert readers.dotted(tree, "a.b") == 0.5 and readers.dotted(tree, "a.c") == [1, "x"] and readers.dotted(tree, "no.way", 7) == 7 and tree["d"] is True
    df = spark.createDataFrame([(1, "한글", [1, 2])], "id int, t string, a array<int>")
    writers.json_lines(df, str(tmp_path / "out"))
    assert "한글" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    writers.csv(df, str(tmp_path / "csv"))
    writers.parquet(df, str(tmp_path / "pq"), ["id"])
    writers.report([{"a": "한"}], str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == [{"a": "한"}] and writers.summary({"x": df})["total"] == 1


def test_inference_and_resume(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id long, prompt string")

    def make():
        return lambda p: p.upper()

    assert {r["model_raw_output"] for r in inference.run(df, make).collect()} == {f"P{i}" for i in range(20)}
    done = spark.createDataFrame([(i,) for i in range(5)], "id long")
    parts = [inference.resumed(df, done, "id", make, k, 3).count() for k in range(3)]
    assert sum(parts) == 15
    assert inference.called(lambda p: 1 / 0, "x", 2, lambda s: None).startswith("[ERROR]")


def test_stream_gives_the_batch_rows(spark, tmp_path):
    rows = [(i, "w " * 12 + f"<ToW>r{i}</ToW> end" + (" <ToW>" if i % 3 == 0 else "")) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, completion string")
    df.write.json(str(tmp_path / "in"))
    streaming.to_files(streaming.from_files(spark, str(tmp_path / "in"), "id long, completion string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["id"] for r in spark.read.schema("id long").json(str(tmp_path / "out")).collect()}
    assert got == {r["id"] for r in streaming.cleaned(df).collect()} and len(got) == 8


def test_panels(spark):
    x = [1.0, 2.0, 2.5, 9.0, float("nan"), None, 4.0]
    df = spark.createDataFrame([*(("a", y) for y in x), (None, 3.0), (None, 3.0), ("none", None)], "g string, x double")
    n, edges = np.histogram([y for y in x if y is not None and y == y], 5)
    got = panels.equal_bins(df, "x", 5, ["g"]).orderBy("bin").collect()
    assert [(r["n"], r["low"], r["high"]) for r in got if r["g"] == "a"] == [(k, round(a, 6), round(b, 6)) for k, a, b in zip(n.tolist(), edges[:-1].tolist(), edges[1:].tolist())]
    assert [(r["n"], r["low"]) for r in got if r["g"] is None] == [(0, 2.5), (0, 2.7), (2, 2.9), (0, 3.1), (0, 3.3)] and len(got) == 10
    assert panels.equal_bins(df.limit(0), "x").count() == 0
    box = panels.boxes(spark.createDataFrame([("a", float(i)) for i in [1, 2, 3, 4, 5, 40]] + [(None, 1.0)], "g string, x double"), "x", ["g"]).where("g = 'a'").first()
    assert (box["n"], box["q1"], box["median"], box["low"], box["high"], box["outside"]) == (6, 2.25, 3.5, 1.0, 5.0, 1)


def test_pair_panels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 5))
    x[3] = x[2]
    x[6] = 0
    df = spark.createDataFrame([(i, "en" if i < 8 else "ko", a.tolist(), rng.normal(size=5).tolist()) for i, a in enumerate(x)], "idx long, lang string, v array<double>, train array<double>").withColumn("base", F.col("v"))
    got = {r["pair_id"]: r["cka"] for r in representation.pair_cka(df).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 1.0}
    assert tuple(representation.pair_cka_panel(representation.pair_cka(df)).first()) == (0, 1.0, 1, 0.0, 0.1875)
    u = x[:8] / np.maximum(1e-300, np.linalg.norm(x[:8], axis=1))[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    assert [(r["lang"], r["distance"]) for r in representation.intra_distance(df).collect()] == [("en", pytest.approx(d.mean(), abs=2e-6))]
    c = [x[:8].mean(axis=0), x[8]]
    want = 1 - c[0] @ c[1] / np.linalg.norm(c[0]) / np.linalg.norm(c[1])
    assert representation.centre_distances(df, "lang").first()["distance"] == pytest.approx(want, abs=2e-6)


def test_dialogue_slots_read_lines_once(spark):
    """Two patterns of two groups: four extractions, however often the slots are used."""
    df = spark.createDataFrame([("area: a\nIntent: x\ntime = b\narea = c",)], "t string").select(extract.dialogue_slots(F.col("t")).alias("s"))
    assert df.first()["s"] == {"area": "c", "time": "b"}
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 4


def test_encoding_in_parts():
    make = lambda s: ([ord(c) for c in s], [mixing.MASK] * len(s))
    frame = pd.DataFrame({"id": range(5), "t": ["aaaa", "b", "", "c" * 30, "dd"]})
    parts = list(mixing._in_parts(iter([frame, frame.iloc[:0]]), ["t"], make, most=5))
    assert [p["id"].tolist() for p in parts] == [[0, 1], [2, 3], [4]]
    assert [len(x) for p in parts for x in p["input_ids"]] == [4, 1, 0, 30, 2] and all(x.dtype == np.int32 for p in parts for c in ("input_ids", "labels", "attention_mask") for x in p[c])
    assert parts[0]["labels"][0].tolist() == [mixing.MASK] * 4


def test_tidy_translations_as_sql(spark, tmp_path):
    """Long runs beside letters that aren't ASCII, and blanks beyond ASCII, as the SQL's patterns take them."""
    run = "x" * 21
    texts = [f"é{run} a", f"a {run}é b", f"가{run}", f"_{run} 1{run} {run}1", f"\u00a0a. \u00a0a.\x0b{run}. b\u2003 c \x0bd", "a \u0085. a", f"{run}\n.", "", ".", f"{run}{run}-{run}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, queries.QUERIES["tidy_translations"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(queries.SQL["tidy_translations"]).fetchall())
    assert one(spark, f"é{run} a", text.tidy_translation) == f"é{run} a."


def test_language_statistics(spark):
    rows = [(1, "en", 0.5, False), (1, "ko", 0.25, False), (2, "en", 1.0, False), (2, "ko", 9.0, True), (3, "en", None, True)]
    got = confidence.language_statistics(spark.createDataFrame(rows, "text_id int, lang string, m double, failed boolean"), "m").first().asDict()
    assert got == {"mean_a": 0.75, "std_a": 0.25, "n_a": 2, "mean_b": 0.25, "std_b": 0.0, "n_b": 1, "errors": 2, "total": 3, "difference": 0.5, "correlation": None}
    lens = [(0, 1, 1, "x", 0.4), (0, 1, 2, "y", 0.3), (0, 2, 1, "y", 0.5), (0, 3, 1, "y", 0.9)]
    df = spark.createDataFrame(lens, "step int, layer int, rank int, token string, prob double")
    assert [tuple(r) for r in confidence.lens_table(df).orderBy("layer").collect()] == [(0, 1, "x", 0.4, False), (0, 2, "y", 0.5, True), (0, 3, "y", 0.9, True)]
    assert [tuple(r) for r in confidence.lens_settled(df).collect()] == [(0, 2)]


def test_tag_report():
    class Whole:
        additional_special_tokens = ["<ToW>"]

        def get_vocab(self):
            return {"a": 0, "<ToW>": 1, "</ToW>": 2}

        def tokenize(self, line):
            return line.replace("</ToW>", "</ ToW>").split(" ")

    told = tokenizers.tag_report(Whole())
    assert told["is_valid"] and told["ids"] == {"<ToW>": 1, "</ToW>": 2} and told["special"] == ["<ToW>"] and told["issues"] == []
    assert told["warnings"] == ["</ToW> is known but doesn't stay whole"]
    assert not tokenizers.tag_report(Whole(), ("<hCoT>", "</hCoT>"))["is_valid"] and not tokenizers.tag_report(object())["is_valid"]
