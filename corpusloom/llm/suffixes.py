"""Removal of repeated substrings by difference-cover suffix sorting of the text around anchors that occur again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import Scratch, documents, order_key, row_hash, rows_of, written

LENGTH, GRAM = 100, 32
#: Bytes of one block of text, whose positions take PLACE_BITS bits beside a hash.
SEGMENT, PLACE_BITS = 1 << 18, 22
#: Bytes that one suffix array is built of, about, and rows that one group brings to it at most. Larger groups are parted until they are
#: under it, so that it bounds memory and changes no result.
ARRAY_BYTES, CROWD = 1 << 19, 512
#: What a row of text is told by and ordered by: the id (null: last), then a hash of the text.
KEY = ("d", "row")
MIXES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (positive integers) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), "i8")
    t = np.concatenate((s.astype("i8"), np.zeros(3, "i8")))
    base = int(t.max()) + 1
    at = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n + (n % 3 == 2), 3)))  # a triple of zeros ends the first part where needed
    at = at[at < n + 1]
    firsts = int((at % 3 == 1).sum())
    if base < 1 << 20:
        names = np.unique((t[at] * base + t[at + 1]) * base + t[np.minimum(at + 2, n + 2)], return_inverse=True)[1] + 1
    else:
        pair = np.unique(t[at] * base + t[at + 1], return_inverse=True)[1] if base < 1 << 31 else None
        names = np.unique(pair * (base + 0) + t[np.minimum(at + 2, n + 2)], return_inverse=True)[1] + 1
    if int(names.max()) < len(at):
        order = suffix_array(names)  # recursion on the names
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 4, "i8")
    rank[at[order]] = np.arange(1, len(at) + 1)
    sampled = at[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = n + 5
    rest_key = t[rest] * wide + rank[rest + 1]
    by = np.argsort(rest_key)
    rest, rest_key = rest[by], rest_key[by]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[one] * wide + rank[one + 1], rest_key)  # merge: each kind by the symbols that lead to ranked suffixes
    deep = lambda i: (t[i] * base + t[i + 1]) * wide + rank[i + 2]
    if base * base * wide < 1 << 62:
        before = before + np.searchsorted(deep(two), deep(rest))
    else:
        heads = np.unique(np.concatenate((t[two] * base + t[two + 1], t[rest] * base + t[rest + 1])), return_inverse=True)[1]
        before = before + np.searchsorted(heads[: len(two)] * wide + rank[two + 2], heads[len(two) :] * wide + rank[rest + 2])
    out = np.empty(n, "i8")
    places = np.arange(len(rest)) + before
    out[places] = rest
    free = np.ones(n, bool)
    free[places] = False
    out[free] = sampled
    return out


def _words8(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,))


def anchors(raw: np.ndarray, spans: list[tuple[int, int]]):
    """(anchor hash, first window, number of windows, bytes from the first window to the anchor) of maximal runs of windows with one anchor; spans: (start, end) of texts in raw.

    A window's anchor is its gram of GRAM bytes with the least hash (the first of equals): equal windows have
    equal anchors in equal places.
    """
    wide = LENGTH - GRAM + 1
    if len(raw) < LENGTH:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    eight, n = _words8(raw), len(raw) - GRAM + 1
    h = np.zeros(n, "u8")
    for k, mix in zip(range(0, GRAM, 8), MIXES):
        h = (h ^ eight[k : k + n]) * mix
        h ^= h >> np.uint64(32)
    m = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype="u8")
    step = 1
    while 2 * step <= wide:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    m = np.minimum(m[: len(m) - (wide - step)], m[wide - step :])
    at = (m & np.uint64((1 << PLACE_BITS) - 1)).astype("i8")
    ok = np.zeros(len(at) + 1, bool)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    for a, b in spans:
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
            fresh[a] = True
    ok = ok[: len(at)]
    heads = np.nonzero(fresh & ok)[0]
    # a run ends at the next head or where its text has no more windows
    stop = np.nonzero(np.append(~ok, True))[0]
    ends = np.minimum(np.append(heads[1:], len(at)), stop[np.searchsorted(stop, heads)]) if len(heads) else heads
    return h[at[heads]], heads, ends - heads, at[heads] - heads


def _segments(ids: list, texts: list[str]):
    """(raw, [(id, offset in the document, start, end)]) with long texts cut where windows overlap by LENGTH - 1."""
    held, parts, size = [], [], 0
    for doc_id, text in zip(ids, texts):
        raw = text.encode()
        for a in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
            piece = raw[a : a + SEGMENT + LENGTH - 1]
            if size + len(piece) > 2 * SEGMENT and held:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            parts.append((doc_id, a, size, size + len(piece)))
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held), parts


def anchor_counts(docs: DataFrame) -> DataFrame:
    """a (anchor), n: of all runs of windows of the texts, summed for each block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, key=KEY):
            for raw, parts in _segments(ids, texts):
                a, n = np.unique(anchors(np.frombuffer(raw, "u1"), [(x[2], x[3]) for x in parts])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(n.astype("i8"))], names=["a", "n"])

    return docs.mapInArrow(run, "a long, n long")


def occurrences(docs: DataFrame) -> DataFrame:
    """a (anchor), g, i (128 bits of a hash of the surroundings: all bytes of the run's windows), d, row, s, p: a row for each run of windows.

    p holds the number of windows in its lower 8 bits, and above these the bytes from the first window to the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for ids, texts in rows_of(batches, key=KEY):
            for raw, parts in _segments(ids, texts):
                a, s, c, to = anchors(np.frombuffer(raw, "u1"), [(x[2], x[3]) for x in parts])
                starts = np.array([x[2] for x in parts])
                part = np.searchsorted(starts, s, "right") - 1
                g = np.frombuffer(b"".join([digest(raw[x:y]) for x, y in zip(s.tolist(), (s + c + LENGTH - 1).tolist())]), "<i8").reshape(-1, 2)
                key = np.array([x[0] for x in parts], "i8").reshape(-1, 2)[part]
                offset = s - starts[part] + np.array([x[1] for x in parts], "i8")[part]
                columns = (a.view("i8"), g[:, 0].copy(), g[:, 1].copy(), key[:, 0].copy(), key[:, 1].copy(), offset.astype("i4"), (c | to << 8).astype("i4"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "g", "i", "d", "row", "s", "p"])

    return docs.mapInArrow(run, "a long, g long, i long, d long, row long, s int, p int")


def _repeats_in(table: pa.Table) -> pa.Table:
    """Windows of the given surroundings (raw, d, row, s, c) that come again later, as runs d, row, s, c."""
    table = table.combine_chunks()
    pieces = table["raw"].to_pylist()
    doc, row, s, c = (table[x].to_numpy().astype("i8") for x in (*KEY, "s", "c"))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0" * 8, "u1")
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces])[:-1]))
    piece = np.repeat(np.arange(len(c)), c)
    inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    window = np.full(len(raw), -1, "i8")
    window[starts[piece] + inner] = np.arange(len(piece))
    order = suffix_array(raw[: len(raw) - 8].astype("i8") + 1)
    order = order[window[order] >= 0]  # suffixes that start a window, in order
    eight = _words8(raw)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # compare the prefixes of neighbours
        e = eight[order + k]
        same &= e[1:] == e[:-1]
    group = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, "i8")
    w = window[order]
    # windows of one place, which equal rows bring more than once, have one turn
    turn, at = np.empty(len(piece), "i8"), s[piece] + inner
    by = np.lexsort((at, row[piece], doc[piece]))
    differs = np.zeros(max(0, len(by) - 1), bool)
    for x in (at, row[piece], doc[piece]):
        differs |= x[by[1:]] != x[by[:-1]]
    turn[by] = np.cumsum(np.append(False, differs))[: len(by)]
    first = np.full(int(group[-1]) + 1 if len(group) else 0, len(piece), "i8")
    np.minimum.at(first, group, turn[w])
    again = np.zeros(len(piece) + 1, bool)
    again[w] = turn[w] > first[group]
    hit = np.nonzero(again[:-1])[0]
    head = np.ones(len(hit), bool)
    head[1:] = (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])
    start = np.nonzero(head)[0]
    of = piece[hit[start]]
    return pa.table({"d": doc[of], "row": row[of], "s": at[hit[start]].astype("i4"), "c": np.diff(np.append(start, len(hit))).astype("i4")})


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, "u1", n), np.frombuffer(b, "u1", n)
    differs = np.nonzero(x != y)[0]
    return int(differs[0]) if len(differs) else n


def against_first(raw: bytes, to: int, c: int, head: bytes, head_to: int) -> tuple[tuple[int, int] | None, list[tuple[str, int, int, int]]]:
    """What of a run's windows (the first `c` of raw, with the anchor at byte `to`) the run `head` has too: ((first window, number)
    or None, the others as (what they are told by, first window, number, bytes to the anchor)).

    Bytes are compared from the anchor to both sides. The others differ from the head on the left, at a place that
    all windows equal to them share with the byte that stands there, or else on the right: so windows that are equal are told by the same.
    """
    left, right = _shared(raw[:to][::-1], head[:head_to][::-1]), _shared(raw[to:], head[head_to:])
    least, most = to - c + 1, to  # bytes that windows have before the anchor
    low, high = max(least, LENGTH - right), min(most, left)
    rest = []
    if most > left:
        n = most - max(least, left + 1) + 1
        rest.append((f"L{left},{raw[to - left - 1]}", 0, n, to))
    end = min(most, left, LENGTH - right - 1)
    if end >= least:
        rest.append((f"R{right},{raw[to + right]}", to - end, end - least + 1, end))
    return ((to - high, high - low + 1) if low <= high else None), rest


RUNS = "k long, d long, row long, s int, c int, to int, raw binary"


def _part(crowd: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """A step of groups (k) of runs: each run against the first of its group. Rows without raw are windows that the first has too, the
    others are the rest, in smaller groups. One row a run, two where it differs on both sides; a group may be split over tasks."""
    first = crowd.groupBy("k").agg(F.min(F.struct("d", "row", "s", "to", "raw")).alias("f"))
    first = scratch.written(first.select(F.col("k").alias("k2"), F.col("f").alias("f")), f"first{turn}")
    met = crowd.join(first, F.col("k") == F.col("k2")).select("k", "d", "row", "s", "c", "to", "raw", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = RUNS.replace(",", "").split()[::2], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                f = r["f"]
                if (r["d"], r["row"], r["s"]) == (f["d"], f["row"], f["s"]):
                    continue
                had, rest = against_first(r["raw"], r["to"], r["c"], f["raw"], f["to"])
                if had:
                    out.append((r["k"], r["d"], r["row"], r["s"] + had[0], had[1], 0, None))
                for told, w, n, to in rest:
                    k = xxhash.xxh3_64_intdigest(f"{r['k']}{told}") - (1 << 63)
                    out.append((k, r["d"], r["row"], r["s"] + w, n, to, r["raw"][w : w + n + LENGTH - 1]))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

    return scratch.written(met.mapInArrow(run, RUNS), f"parted{turn}")


def _sized(runs: DataFrame, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame]:
    """Runs of groups that fit in an array, and of larger ones; runs alone in their group go."""
    sizes = scratch.written(runs.groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n")).where("n > 1"), f"sizes{turn}")
    pick = lambda of: runs.join(sizes.where(of), F.col("k") == F.col("k2"), "left_semi")
    return pick(F.col("n") <= CROWD), pick(F.col("n") > CROWD)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, d, row."""
    own = documents(docs)
    return own.select("doc_id", "text", order_key(F.col("doc_id")).alias("d"), row_hash(F.col("text")).alias("row"))


def repeats(docs: DataFrame) -> DataFrame:
    """docs as of `keyed` -> d, row, s, c: runs of c windows from byte s on that all start earlier too (rows may overlap)."""
    docs = docs.select("d", "row", "text")
    with Scratch(docs.sparkSession) as scratch:
        # 1. anchors that occur more than once; all other windows are unique. The anchors are worked out a second time below: writing all runs would take 1.6 x the input
        often = scratch.written(anchor_counts(docs).groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "often")
        met = scratch.written(occurrences(docs).join(often, "a", "left_semi"), "met")
        # 2. equal surroundings, by 128 bits: all but the first repeat it whole
        same = ["a", "g", "i"]
        equal = scratch.written(met.groupBy(*same).agg(F.min(F.struct("d", "row", "s", "p")).alias("f"), F.count("*").alias("n")), "equal")
        first = equal.where("n > 1").select(*(F.col(c).alias(f"{c}2") for c in same), "f")
        whole = met.join(first, [F.col(c) == F.col(f"{c}2") for c in same]).where("d != f.d or row != f.row or s != f.s")
        whole = written(whole.select("d", "row", "s", F.col("p").bitwiseAND(255).alias("c")), "whole")
        scratch.free("met")
        # 3. different surroundings of one anchor: the text of the first of each kind
        kinds = scratch.written(equal.groupBy(F.col("a").alias("k2")).agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
        runs = equal.join(kinds, F.col("a") == F.col("k2")).select("a", F.col("kinds").alias("n"), "f.d", "f.row", "f.s", F.col("f.p").bitwiseAND(255).alias("c"), F.shiftright("f.p", 8).alias("to"))
        asked = runs.groupBy(F.col("d").alias("d2"), F.col("row").alias("row2")).agg(F.collect_list(F.struct("a", "n", "s", "c", "to")).alias("runs"))
        with_text = docs.join(asked, (F.col("d") == F.col("d2")) & (F.col("row") == F.col("row2"))).select("d", "row", "text", "runs")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, row, text, own in zip(batch.column("d").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), batch.column("runs")):
                    raw, got = text.as_py().encode(), own.values
                    a, n, s, c, to = (got.field(k).to_numpy(zero_copy_only=False) for k in ("a", "n", "s", "c", "to"))
                    parts = [raw[x:y] for x, y in zip(s.tolist(), (s + c + LENGTH - 1).tolist())]
                    columns = [pa.array(a), pa.array(np.full(len(a), d, "i8")), pa.array(np.full(len(a), row, "i8")), pa.array(s), pa.array(c), pa.array(to), pa.array(parts, pa.binary()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "d", "row", "s", "c", "to", "raw", "n"])

        texts = scratch.written(with_text.mapInArrow(cut, f"{RUNS}, n long"), "surroundings")
        scratch.free("equal")
        # 4. crowded anchors: against their first run, again and again, in smaller and smaller groups
        fit, crowd, found = texts.where(F.col("n") <= CROWD).drop("n"), texts.where(F.col("n") > CROWD).drop("n"), []
        turn = 0
        while crowd.limit(1).count():
            parted = _part(crowd, scratch, turn)
            found.append(parted.where("raw is null").select("d", "row", "s", "c"))
            more, crowd = _sized(parted.where("raw is not null"), scratch, turn)
            fit, turn = fit.unionByName(more), turn + 1
        # 5. suffix arrays of groups together
        size = fit.agg(F.sum(F.length("raw"))).first()[0] or 0
        arrays = max(1, -(-size // ARRAY_BYTES))
        dealt = fit.withColumn("__array", F.pmod(F.xxhash64("k"), F.lit(arrays))).select("__array", "d", "row", "s", "c", "raw")
        found.append(dealt.groupBy("__array").applyInArrow(_repeats_in, "d long, row long, s int, c int"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return whole.unionByName(written(out, "shared"))


def remove_repeats(docs: DataFrame, characters: bool = False, whole_row: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end), kept (binary): each text without the bytes of 100-byte strings that start earlier.

    Earlier: in a document of smaller id, or further ahead in the same one. Matches never cross documents and are judged on the
    input. A null text counts as empty; texts under 100 bytes stay as they are. Rows are ordered by id, a null id last, and
    by a hash of the text where ids are equal, so that of rows with one id but different texts the later loses what the other has; rows of equal id
    and text are one document, and each of them loses its spans. No documents, no rows; other columns are
    ignored. characters: a character that loses a byte goes whole. whole_row: a struct `own` of all columns of docs, whatever their names, comes too.
    """
    extra = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("own")] if whole_row else []
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *extra)
    own = own.withColumns({"d": order_key(F.col("doc_id")), "row": row_hash(F.col("text"))})
    spans = repeats(own).groupBy(F.col("d").alias("d2"), F.col("row").alias("row2")).agg(F.collect_list(F.struct("s", "c")).alias("runs"))
    both = own.join(spans, (F.col("d") == F.col("d2")) & (F.col("row") == F.col("row2")), "left").select("doc_id", "text", *(["own"] if whole_row else []), "runs")

    def merged(raw: bytes, found: pa.Scalar) -> list[tuple[int, int]]:
        if not (found.is_valid and len(found)):
            return []
        s, c = found.values.field("s").to_numpy().astype("i8"), found.values.field("c").to_numpy().astype("i8")
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.minimum(np.maximum.accumulate((s + c + LENGTH - 1)[order]), len(raw))
        heads = np.nonzero(np.append(True, s[1:] > e[:-1]))[0]
        out = list(zip(s[heads].tolist(), e[np.append(heads[1:], len(s)) - 1].tolist()))
        if characters:  # bytes 10xxxxxx go on with a character
            for k, (a, b) in enumerate(out):
                while a and raw[a] & 0xC0 == 0x80:
                    a -= 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
                out[k] = (a, b)
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, out, since, held = batch.column("text"), batch.column("runs"), ([], [], []), 0, 0
            for i in range(batch.num_rows):
                raw, kept, at = texts[i].as_py().encode(), [], 0
                spans = merged(raw, runs[i])
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = max(at, b)
                kept.append(raw[at:])
                for column, value in zip(out, (len(raw), [{"start": a, "end": b} for a, b in spans], b"".join(kept))):
                    column.append(value)
                held += len(raw)
                if held > 16 * SEGMENT or i + 1 == batch.num_rows:
                    same = [batch.column(c).slice(since, i + 1 - since) for c in names]
                    kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, k) for x, k in zip(out, kinds))], names=[*names, "n_bytes", "spans", "kept"])
                    out, since, held = ([], [], []), i + 1, 0

    names = ["doc_id", *(["own"] if whole_row else [])]
    schema = StructType(list(both.select(*names).schema.fields)).add("n_bytes", "long").add("spans", ArrayType(StructType().add("start", "long").add("end", "long"))).add("kept", "binary")
    return both.mapInArrow(cut, schema)
