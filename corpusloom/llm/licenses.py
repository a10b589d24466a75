"""License scans: MinHash bands over overlapping windows retrieve templates; exact shingle containment verifies them."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Memo
from .common import documents, rows_of

SHINGLE, CONTAINMENT = 5, 0.8
#: One hash a band: a window that shares a part J of its shingles with a template is retrieved with probability
#: 1 - (1 - J) ** BANDS. Windows are at most 1.5 times their class, and a template more than half of it: with a
#: containment of 0.8, J is 0.23 at least, and the probability 0.99999994.
BANDS = 64
WORD = re.compile(r"[^\W_]+")
MIXES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

#: Notices and opening grants of well-known public licences. Whole licences are files of the folder templates.
NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


@cache
def texts() -> dict[str, str]:
    """The notices and the whole texts, by name."""
    files = (f for f in resources.files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt"))
    return NOTICES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8", errors="replace") for f in sorted(files, key=lambda f: f.name)}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(tokens: list[str]) -> list[tuple[str, ...]]:
    return [tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1)]


def _word_hash(word: str) -> int:
    raw = word.encode("utf-8", "replace")
    return zlib.crc32(raw) | zlib.adler32(raw) << 32


def _shingle_hashes(word_hashes: np.ndarray) -> np.ndarray:
    n = len(word_hashes) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, "u4")
    h = np.zeros(n, "u8")
    for k, mix in enumerate(MIXES):
        h = (h ^ word_hashes[k : k + n]) * mix
    h ^= h >> np.uint64(31)
    return ((h * MIXES[0]) >> np.uint64(32)).astype("u4")


class Templates:
    """The templates by length class (a power of two of shingles), with an index from each band's minimum to them: the work follows the windows, not the templates."""

    def __init__(self, texts: dict[str, str]):
        rng = np.random.default_rng(7)
        self.multiply = (rng.integers(1 << 31, size=BANDS, dtype="u4") << np.uint32(1)) | np.uint32(1)
        self.add = rng.integers(1 << 32, size=BANDS, dtype="u4")
        self.sets: dict[str, set] = {}
        self.classes: dict[int, list[str]] = {}
        self.index: dict[int, list[tuple[np.ndarray, list[list[str]]]]] = {}  # by class and band: the sorted minima, and who has each
        for name, text in texts.items():
            own = set(shingles(words(text)))
            if not own:
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            self.sets[name] = own
            self.classes.setdefault(1 << (len(own) - 1).bit_length(), []).append(name)
        for size, names in self.classes.items():
            rows = [self.bands(_shingle_hashes(np.array([_word_hash(w) for w in words(texts[x])], "u8"))).min(axis=1) for x in names]
            for band in np.array(rows).T:
                found, of = np.unique(band, return_inverse=True)
                self.index.setdefault(size, []).append((found, [[names[t] for t in np.nonzero(of == i)[0]] for i in range(len(found))]))

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        return hashes[None, :] * self.multiply[:, None] + self.add[:, None]

    def retrieve(self, hashes: np.ndarray) -> set[tuple[int, int, str]]:
        """(first shingle, end, template) of windows that share a band's minimum with a template of their class."""
        found, n = set(), len(hashes)
        for b in range(BANDS):
            block, width = hashes * self.multiply[b] + self.add[b], 1
            for size in sorted(self.classes):
                stride = max(1, size // 2)
                while width < stride:
                    if len(block) % 2:
                        block = np.append(block, np.uint32(0xFFFFFFFF))
                    block, width = np.minimum(block[::2], block[1::2]), width * 2
                window = block
                if size > 1:  # three blocks in a row hold any run of `size` shingles
                    padded = np.concatenate((block, np.full(2, 0xFFFFFFFF, "u4")))
                    window = np.minimum(np.minimum(padded[:-2], padded[1:-1]), padded[2:])
                least, names = self.index[size][b]
                at = np.minimum(np.searchsorted(least, window), len(least) - 1)
                for i in np.nonzero(least[at] == window)[0].tolist():
                    span = i * stride, min(n, (i + (3 if size > 1 else 1)) * stride)
                    found.update((*span, name) for name in names[int(at[i])])
        return found


def best_run(tokens: list[str], template: set, longest: int, base: int = 0) -> tuple[float, int] | None:
    """(largest containment of a run of at most `longest` shingles, first shingle of the first run that reaches CONTAINMENT)."""
    need, hits = math.ceil(CONTAINMENT * len(template) - 1e-9), [(i, s) for i, s in enumerate(shingles(tokens)) if s in template]
    held: dict = {}
    first, most, left = None, 0, 0
    for i, s in hits:
        held[s] = held.get(s, 0) + 1
        while hits[left][0] <= i - longest:
            old = hits[left][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            left += 1
        if len(held) >= need and first is None:
            first = base + hits[left][0]
        most = max(most, len(held))
    return (most / len(template), first) if first is not None else None


def scan_texts(texts: list[str], templates: Templates, memo: Memo) -> list[list[tuple[str, float, int]]]:
    """For each text (template, containment, first word) by name."""
    tokens = [words(t) for t in texts]
    hashes = _shingle_hashes(np.fromiter((h for ws in tokens for h in map(memo.__getitem__, ws)), "u8", sum(map(len, tokens))))
    ends = np.cumsum([len(ws) for ws in tokens])
    regions: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for a, b, name in templates.retrieve(hashes):
        for d in range(int(np.searchsorted(ends, a, "right")), min(len(texts) - 1, int(np.searchsorted(ends, b + SHINGLE - 1, "left"))) + 1):
            start = int(ends[d]) - len(tokens[d])
            size = 1 << (len(templates.sets[name]) - 1).bit_length()
            regions.setdefault((d, name), []).append((max(0, a - start - size), b - start + size + SHINGLE - 1))
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    for (d, name), spans in sorted(regions.items()):
        size, merged = 1 << (len(templates.sets[name]) - 1).bit_length(), []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        runs = [r for a, b in merged if (r := best_run(tokens[d][a:b], templates.sets[name], size, a))]
        if runs:
            out[d].append((name, max(r[0] for r in runs), min(r[1] for r in runs)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word: a row for each document and template that it holds.

    A template is held if a run of shingles (of five words; no longer than the template's class, the next
    power of two) contains 0.8 or more of the template's distinct shingles; containment is the largest of any run, first_word
    counts the document's words. Null texts and texts of under five words hold none; null and repeated ids
    are kept; no documents, no rows; other columns are ignored. `templates` (name to text) are held by every worker;
    a few hundred kilobytes of notices and whole licences are built in.
    """
    chosen = dict(templates or texts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = Templates(chosen), Memo(_word_hash)
        for ids, block in rows_of(batches):
            told = [(i, *x) for i, found in zip(ids, scan_texts(block, known, memo)) for x in found]
            columns = list(zip(*told)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()))], names=["doc_id", "license", "containment", "first_word"])

    return documents(docs).mapInArrow(run, "doc_id long, license string, containment double, first_word long")
