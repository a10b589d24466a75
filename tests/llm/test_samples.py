"""Importance resampling, token files and spelling variants against brute force, the library and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import queries, resampling, spelling, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
ODD = [None, "", " ", "  a", "a  b \n\n c", "x<|endoftext|>y <|startoftext|> z", "It's we'll  don't\t\tno", "naïve ÉÀ ß 한국어 日本 🙂🙂 　x y \x1c\x1d z\x85 é ́", "a" * 3000, "ab" * 4000 + " " * 500 + "c", "\n \n", "1234 56.7!!??", "ΣΑΣ ΑΣ İi", "\x00\x00a\x00"]


def odd_documents(spark, texts=ODD):
    rows = [(i, t, "x", i, 1) for i, t in enumerate(texts)] + [(None, "no id here, none at all", "y", 1, 1), (0, texts[0], "x", 0, 1), (3, "another of that id", "z", 0, 1), (None, "no id here, none at all", "y", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, rank int, row int")


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % resampling.BUCKETS


def drawn_by_hand(docs, targets, percent=25, least=20, seed=7):
    """doc_id -> (n_features, weight, score, rank), one by one; ids must differ."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in targets:
        t.update(map(bucket, grams(text)[1]))
    total_s, total_t, b = sum(s.values()), sum(t.values()), resampling.BUCKETS
    told, fit = {}, []
    for i, text in docs:
        words, f = grams(text)
        gain = [math.floor(1000 * math.log((t[k] + 1.0) * (total_s + b) / ((s[k] + 1.0) * (total_t + b)))) for k in map(bucket, f)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        told[i] = [len(f), weight, score, None]
        if len(words) >= least:
            fit.append((-score, math.inf if i is None else i, i))
    for rank, (_, _, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        told[i][3] = rank
    return {i: tuple(x) for i, x in told.items()}


def test_resampling_by_hand(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    want = drawn_by_hand(docs, [r["text"] for r in queries.table(spark, sf_dir, "benchmark").collect()])
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in queries.op11_importance_resampling(spark, sf_dir).collect()}
    assert got == want and sum(r[3] is not None for r in want.values()) > 10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9é한 .\n"), max_size=200), max_size=8), st.integers(1, 40))
def test_features_of_any_segments(texts, segment):
    before, resampling.SEGMENT = resampling.SEGMENT, segment
    try:
        got, single = [[] for _ in texts], [0] * len(texts)
        array = pa.array(["cut off", *texts], pa.string())[1:]
        for rows, buckets, words in resampling.features(array):
            for i, b in zip(rows.tolist(), buckets.tolist()):
                got[i].append(b)
            for i in rows[:words].tolist():
                single[i] += 1
    finally:
        resampling.SEGMENT = before
    assert [sorted(x) for x in got] == [sorted(map(bucket, grams(t)[1])) for t in texts]
    assert single == [len(grams(t)[0]) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 127, 128, 5000, 1 << 17])
def test_checksum_of_long_words(n):
    a, b = b"some words", bytes(random.Random(n).randrange(256) for _ in range(n))
    got = resampling.followed(np.array([zlib.crc32(a)], "u4"), np.array([zlib.crc32(b)], "u4"), np.array([n]))
    assert got.tolist() == [zlib.crc32(a + b)]


def test_resampling_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(300_000))
    texts = [*ODD, long, *(f"{'a few words that recur ' * 5}{i}" for i in range(40))]
    docs = odd_documents(spark, texts)
    target = spark.createDataFrame([("word1 word2 a few",), (None,)], "text string")
    got = resampling.resample(docs, target, percent=50).collect()
    assert len(got) == len(texts) + 4
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    fit = sum(r["n_words"] >= 20 for r in got)
    assert ranks == list(range(1, fit // 2 + 1)) and fit > 40
    by_rank = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in by_rank] == sorted((r["score"] for r in got if r["n_words"] >= 20), reverse=True)[: len(ranks)]
    assert {r["n_words"] for r in got if r["doc_id"] == len(ODD)} == {300_000}
    assert all(r["weight"] == 0 for r in got if not r["n_features"])
    kept = resampling.sample(docs, target, percent=50)
    assert kept.columns == docs.columns and kept.count() == len(ranks)
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0), percent=0).where("rank IS NOT NULL").count() == 0


def test_resampling_draws_what_the_target_is_like(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("sea ship sail wind", "bread oven flour salt")[i % 4 > 0].split()) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for i, t in rows if i % 4 == 0], "text string")
    drawn = [r["doc_id"] for r in resampling.sample(docs, target).collect()]
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 60


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sßΣİ́　 <|endoftext|>")), max_size=60))
def test_word_ids_as_the_library(text):
    with open(WORDS, "rb") as f:
        own = token_files.encoder(f.read())
    assert own.apart
    assert np.frombuffer(own.encode(text), own.kind).tolist() == library_ids(text)


def test_word_ids_of_every_blank_and_mark():
    with open(WORDS, "rb") as f:
        own = token_files.encoder(f.read())
    for c in [*range(0x3100), *range(0xFB00, 0xFFFE)]:
        text = f"a {chr(c)} b{chr(c)}\n{chr(c)}c it{chr(c)}'s 1{chr(c)}{chr(c)}2"
        assert np.frombuffer(own.encode(text), own.kind).tolist() == library_ids(text), hex(c)


def test_other_vocabularies_come_whole():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        own = token_files.Encoder(f.read())
    text = "two  words and\n\n more "
    assert not own.apart
    assert np.frombuffer(own.encode(text), own.kind).tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_token_files_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op12_token_files(spark, sf_dir).collect()}
    start = 0
    docs = sorted(queries.table(spark, sf_dir, "documents").collect(), key=lambda r: r["doc_id"])
    for r in docs:
        ids = library_ids(r["text"]) + [1]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (start, len(ids))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(docs)


@pytest.mark.parametrize(("sequence", "rows", "batch"), [(2048, 1 << 16, 256), (64, 3, 2), (41, 40, 7)])
def test_token_files_odd_rows(spark, tmp_path, sequence, rows, batch):
    texts = [*ODD, "many words " * 1_000]
    docs, folder = odd_documents(spark, texts), f"file://{tmp_path}/ids"
    told = token_files.write(docs, WORDS, folder, sequence=sequence, rows=rows, batch=batch).collect()
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [0, 0, 1, 2, 3, 3, *range(4, len(texts)), None, None]
    want = {i: [library_ids(t) + [1]] for i, t in enumerate(texts)}
    want[3].append(library_ids("another of that id") + [1])
    want[None] = [library_ids("no id here, none at all") + [1]]
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in want[r["doc_id"]] and (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
    assert sum(r["n_tokens"] for r in told) == at and sum(r["n_documents"] for r in told) == len(got)
    last = {r["block"]: max(x["file"] for x in told if x["block"] == r["block"]) for r in told}
    assert all(r["n_sequences"] == rows for r in told if r["file"] < last[r["block"]])
    reader, stream = token_files.Reader(folder, told), [x for r in got for x in np.frombuffer(r["ids"], "<u4").tolist()]
    assert reader.n_sequences == sum(r["n_sequences"] for r in told)
    seen = []
    for i in range(reader.n_sequences):
        ids, mask = reader.ids(i), np.array(reader.mask(i))
        assert len(ids) == len(mask) == sequence and not ids.flags.owndata and not ids[~mask].any()  # a view
        assert (np.diff(mask.astype(int)) <= 0).all()
        seen += ids[mask].tolist()
    assert seen == stream
    with pytest.raises(IndexError):
        reader.ids(reader.n_sequences)
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checksums(spark, folder).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in got}


def test_token_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_files.write(odd_documents(spark).limit(0), WORDS, folder).count() == 0
    assert token_files.read(spark, folder).count() == 0


def spelled_by_hand(docs, slips=199, least=6, count=5, ratio=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    want = spelled_by_hand(docs)
    assert told(queries.op13_spelling_variants(spark, sf_dir)) == want
    assert any(x[0] for x in want.values()) and any(x[3] > 1 for x in want.values())


@pytest.mark.parametrize("alphabet", ["ab", "aeé×÷Éÿ", "abcdefghij"])
def test_spelling_of_crowded_bands(spark, alphabet):
    rng = random.Random(alphabet)
    vocabulary = list({"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))) for _ in range(400)})
    docs = [(i, " ".join(w for w in vocabulary for _ in range(rng.choice((0, 1, 1, 7))))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert told(spelling.variants(df, slips=7)) == spelled_by_hand(docs, slips=7)
    assert told(spelling.variants(df, slips=0, least_length=5, ratio=2)) == spelled_by_hand(docs, slips=0, least=5, ratio=2)


def test_spelling_joins_without_broadcasts(spark, tmp_path):
    """A small table of words has twelve rows a word in the join; Spark's estimate leaves these out."""
    rows = [(f"word{i:05d}abc", 5) for i in range(2000)]
    spelling._masked(spark.createDataFrame(rows, "word string, n long")).write.parquet(f"{tmp_path}/words")
    met = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
    assert met.count() and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_spelling_odd_rows(spark):
    texts = [*ODD, "colour " * 50 + "color " * 5 + "colours " * 300 + "COLOURSÀ x", "aaaaaa " * 6 + "aaaaaaa " * 60, "letter" * 20_000 + " " + ("w" * 5000 + " ") * 6]
    df = odd_documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = told(spelling.variants(df))
    assert got == spelled_by_hand(rows)
    assert got["colour"][:2] == ("colours", "colours")
    assert got["aaaaaa"][:2] == ("aaaaaaa", "aaaaaaa")
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)
