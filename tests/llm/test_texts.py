"""BPE, packing, licences and suffix removal against the library, bounds and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe, licenses, packing, queries, suffixes
from corpusloom.llm.bpe import Memo

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  b \n\n c", "x<|endoftext|>y <|endoftext|>", "it's we'll  don't\t\tno", "naïve 한국어 日本 🙂🙂 \u3000x\u00a0y \x1c\x1d z\x85", "a" * 3000, "ab" * 4000 + " " * 500, "\n \n", "1234 56.7!!??"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.BytePairCodec(f.read())


def odd_documents(spark, texts=ODD):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "no id here", "y", 1), (0, texts[0], "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_as_the_library(text):
    with open(PATH, "rb") as f:
        codec = bpe.codec(f.read())
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.fast_encoder(codec.spec).encode(text) == codec.encode(text)


def test_bpe_every_blank_and_script(library, own):
    for c in [*range(0x3100), *range(0xFE00, 0xFFFE)]:
        text = f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)
        assert bpe.fast_encoder(own.spec).encode(text) == own.encode(text), hex(c)


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000 "])
def test_bpe_long_runs_of_blanks(own, blank):
    for text in (f"a{blank * 1_200_000}", f"{blank * 1_200_000}b c  {blank * 1500}d", f"{blank * 600_000}<|endoftext|>{blank * 1_200_000}'s"):
        assert bpe.fast_encoder(own.spec).encode(text) == own.encode(text)


def test_bpe_query(spark, sf_dir, library):
    docs = queries.table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in queries.op4_bpe_roundtrip(spark, sf_dir).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        told = got[r["doc_id"]]
        assert told["n_tokens"] == len(ids)
        assert told["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert told["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    docs = odd_documents(spark)
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert list(r["ids"]) == library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids and r["decoded"] == (ODD[r["doc_id"]] or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def check_packing(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def test_packing_query(spark, sf_dir, library):
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d in queries.table(spark, sf_dir, "documents").collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 2048)))
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == 2048 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    lengths = np.array([r["length"] for r in rows])
    assert check_packing(rows) <= packing.lower_bound(np.bincount(lengths, minlength=2049)) + 1


def test_packing_exchanges(spark):
    rng = random.Random(3)
    items = [(i, 0, rng.choice([5, 300, 700, 1100, 2047, 2048])) for i in range(4000)]
    df = spark.createDataFrame(items, "doc_id long, piece int, length long")
    rows = packing.pack(df, group=300).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted((a, c) for a, _, c in items)
    whole = len(packing.best_fit_decreasing(np.array([c for _, _, c in items]))[2])
    assert check_packing(rows) <= whole + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_equal_and_clashing_rows(spark):
    """Equal rows and such without ids part into groups, columns of any name stay, a new packing is never worse."""
    rows = [(None, 0, 700, "g", 5, 1)] * 900 + [(3, 0, 1400, "h", 6, 2)] * 300 + [(i, 1, 2048, "o", 7, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length int, group string, row int, open int")
    clash = df.selectExpr("*", "9L AS sequence_id", "'x' AS offset", "1 AS first", "2 AS number")
    got = packing.pack(clash, group=100).collect()
    assert sorted(got[0].asDict()) == sorted([*df.columns, "first", "number", "sequence_id", "offset"]) and len(got) == len(rows)
    assert sorted(((r["doc_id"], r["length"], r["group"]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in rows), key=str)
    sizes = {}
    for r in got:
        sizes[r["sequence_id"] >> 24] = sizes.get(r["sequence_id"] >> 24, 0) + 1
    assert max(sizes.values()) < 200
    assert check_packing(got) <= 450 + 300 + 20 + 5  # two of 700, one of 1400, one of 2048 to a bin
    bins = [check_packing(packing.pack(df, group=100, rounds=r).collect()) for r in (0, 1, 4)]
    assert bins == sorted(bins, reverse=True)


def test_bound_never_above_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 33, rng.integers(1, 40))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 32)
        assert fills.max() <= 32 and fills.sum() == lengths.sum()
        assert -(-lengths.sum() // 32) <= packing.lower_bound(np.bincount(lengths, minlength=33), 32) <= len(fills)


def test_packing_odd_rows(spark):
    rows = packing.pieces(odd_documents(spark), PATH).collect()
    assert len({r["doc_id"] for r in rows}) == len(ODD) + 1 and min(r["length"] for r in rows) == 1


def licences_by_hand(text):
    found = {}
    held = licenses.shingles(licenses.words(text))
    for name, template in licenses.texts().items():
        own = set(licenses.shingles(licenses.words(template)))
        size = 1 << (len(own) - 1).bit_length()
        hits = [(i, s) for i, s in enumerate(held) if s in own]
        if len(hits) < 0.8 * len(own) - 1e-9:
            continue
        runs = [(len({s for j, s in hits if i <= j < i + size}) / len(own), i) for i, _ in hits[:: max(1, len(hits) // 400)]]
        good = [(c, i) for c, i in runs if c >= 0.8 - 1e-12]
        if good:
            found[name] = max(c for c, _ in runs)
    return found


def test_licences_against_all_runs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    rng = random.Random(5)
    assert len(licenses.texts()) >= 30
    for i, (name, text) in enumerate(licenses.NOTICES.items()):
        ws = text.split()
        for j in range(20):
            cut = [w if rng.random() > 0.03 * (j % 5) else "other" for w in ws]
            docs.append((100_000 + 100 * i + j, f"{docs[j][1][:400]} {' '.join(cut)} {docs[j + 1][1][:300]}"))
    df = spark.createDataFrame([*docs, (None, None), (7, ""), (7, "Released under the MIT License.")], "doc_id long, text string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    assert got.pop(7)["mit-notice"] == 1.0
    for i, text in docs:
        if i != 7:
            assert got.get(i, {}) == pytest.approx(licences_by_hand(text)), i


def test_whole_licences_are_found():
    """Edited copies of all templates inside other text: each that holds 0.8 of its template's shingles is found."""
    rng, t, memo = random.Random(8), licenses.Templates(licenses.texts()), Memo(licenses._word_hash)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    wanted = found = 0
    for name, text in licenses.texts().items():
        own, ws = set(licenses.shingles(licenses.words(text))), text.split()
        for j in range(6):
            cut = f"{filler(rng.randint(0, 300))} {' '.join(w if rng.random() > 0.008 * j else 'other' for w in ws)} {filler(rng.randint(0, 300))}"
            size = 1 << (len(own) - 1).bit_length()
            run = licenses.best_run(licenses.words(cut), own, size)
            if run is None:
                continue
            wanted += 1
            told = {n: (c, at) for n, c, at in licenses.scan_texts([cut], t, memo)[0]}
            found += told.get(name) == pytest.approx(run)
    assert wanted >= 100 and found >= 0.99 * wanted, (found, wanted)


def test_licence_place():
    t, memo = licenses.Templates(licenses.texts()), Memo(licenses._word_hash)
    (found,) = licenses.scan_texts(["one two three. Released under the MIT License, thanks"], t, memo)
    assert found == [("mit-notice", 1.0, 3)]
    assert licenses.scan_texts(["", "too short"], t, memo) == [[], []]


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 50, 51, 52, 301]:
        for k in (1, 2, 5, 200):
            s = rng.integers(1, k + 1, n)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist()), (n, k)


def removed_by_hand(docs):
    """{doc_id: (bytes, spans)} by a table of all 100-byte strings."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        told, own = told_by_hand(text, seen)
        seen |= own
        out[doc_id] = told
    return out


def told_by_hand(text, seen):
    """((bytes, bytes removed, spans, hash of the rest), strings of the text) where the strings `seen` start earlier."""
    raw, own = (text or "").encode(), set()
    gone = bytearray(len(raw))
    for i in range(len(raw) - 99):
        w = raw[i : i + 100]
        if w in seen or w in own:
            gone[i : i + 100] = b"\1" * 100
        own.add(w)
    kept = bytes(b for b, g in zip(raw, gone) if not g)
    spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
    return (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()), own


def digest(rows):
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


def test_suffix_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_suffix_dedup(spark, sf_dir).collect()}
    assert got == removed_by_hand(docs)


@pytest.mark.parametrize("crowd", [1, 3, 2000])
def test_suffix_planted(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß한") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30), text(60), text(15), text(8)]
    docs = [(i * 3, text(rng.randint(0, 80)) + rng.choice(["", " ", *shared]) + text(rng.randint(0, 40)) + rng.choice(shared)) for i in range(120)]
    docs += [(1, "z" * 450), (2, "z" * 250), (4, "xy" * 300), (5, docs[7][1]), (7, docs[7][1][: len(docs[7][1]) // 2] + "!" + docs[7][1][len(docs[7][1]) // 2 :]), (8, ""), (10, "q" * 99), (11, "q" * 100), (13, "q" * 101)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, s int")
    assert digest(suffixes.remove_repeats(df).collect()) == removed_by_hand(docs)


def test_suffix_crowd(spark):
    """More surroundings of one line than an array takes: some alike on the left, some on the right, few on both."""
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefghij ") for _ in range(70))
    part = lambda n: "".join(rng.choice("abc") for _ in range(n))
    lefts, rights = [part(60) for _ in range(40)], [part(60) for _ in range(40)]
    docs = [(i, part(rng.randint(0, 40)) + rng.choice(lefts)[rng.randint(0, 50) :] + line + rng.choice(rights)[: rng.randint(0, 60)] + part(30)) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest(suffixes.remove_repeats(df).collect()) == removed_by_hand(docs)


def test_against_first():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(2))
        gram = b"g" * suffixes.GRAM
        x, y = a + gram + bytes(rng.choice(b"ab") for _ in range(rng.randint(68, 90))), b + gram + bytes(rng.choice(b"ab") for _ in range(rng.randint(68, 90)))
        windows = lambda r, to: {to - i: r[i : i + 100] for i in range(min(to, len(r) - 100) + 1)}
        own, other = windows(x, len(a)), windows(y, len(b))
        had, rest = suffixes.against_first(x, len(a), len(own), y, len(b))
        got = {len(a) - had[0] - k for k in range(had[1])} if had else set()
        assert got == {o for o in own if own[o] == other.get(o)}
        left = [to - k for _, w, n, to in rest for k in range(n)]
        assert sorted([*left, *got]) == sorted(own) and all(len(a) - w == to for _, w, _, to in rest)


def test_suffix_long_text_and_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900_000))
    docs = [(1, base + base[1000:400_000] + base[5:300]), (2, base[899_000:] + "tail"), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest(suffixes.remove_repeats(df).collect()) == removed_by_hand(docs)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def repeats_by_rows(rows):
    """{(id, text): what of the text is left} of rows in the order of id (null: last) and hash; equal rows are one document."""
    seen, out = set(), {}
    for doc_id, _, text in sorted({(i, h, t) for i, h, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        told, own = told_by_hand(text, seen)
        seen |= own
        out[doc_id, text] = told[1:]
    return out


def test_repeated_and_absent_ids(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other = words(70), words(40)
    rows = [(1, f"{passage} c {words(20)}"), (3, f"{passage} a {other}"), (3, "short"), (3, words(200)), (3, f"x {other}"), (3, f"x {other}"), (5, f"at first {passage}"), (5, f"at first {passage}"), (None, f"{passage} n"), (None, f"{passage} n"), (None, f"{words(30)} {other}"), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, d int")
    hashed = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, ''))", "coalesce(text, '')").collect()]
    want = repeats_by_rows(hashed)
    got = suffixes.remove_repeats(df, whole_row=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["own"]["doc_id"] == r["doc_id"] and r["own"]["d"] == 1
        told = sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()
        assert told == want[r["doc_id"], r["own"]["text"] or ""]


def test_removal_by_characters(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("é한�z") for _ in range(90))
    # the bytes before and after the passage have one byte of their character in common
    df = spark.createDataFrame([(1, f"a©{passage}è"), (2, f"한é{passage}é tail �")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.remove_repeats(df, characters=True).collect()}
    assert got == {1: f"a©{passage}è", 2: "한 tail �"}


def test_repeated_rows_beside_a_sharing_document(spark):
    passage = " ".join(f"word{i * i}" for i in range(60))
    text, other = f"at first {passage} and an end", f"another way in {passage} then more"
    df = spark.createDataFrame([(3, text), (3, text), (5, other)], "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffixes.remove_repeats(df).collect())
    assert got[:2] == [(3, text)] * 2
    assert passage not in got[2][1] and got[2][1].startswith("another way in") and got[2][1].endswith("then more")
