"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly linked list, decoding by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, rows_of

#: Fixed value: the published pattern that cuts text into pieces before byte-level merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The blanks of Unicode.
BLANKS = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_BLANKS = re.compile(f"[{BLANKS}]{{1000,}}")
#: A space before white space or the end: only there do pieces reach over a blank.
RUN_OF_BLANKS = re.compile(r" (?:\s|\Z)")
#: Entries that a worker's memo may hold before it starts anew, and the longest string that enters it.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 120


def byte_letters() -> dict[str, int]:
    """The published letter of each byte: printable Latin-1 as it is, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A bounded memo of a function of short strings."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class BytePairCodec:
    """Encodes as the vocabulary's own library does (added tokens in a text count as such), and decodes."""

    def __init__(self, spec: bytes):
        self.spec = spec
        told = json.loads(spec)
        letters = byte_letters()
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left], vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.decimals = [str(i) for i in range(size)]
        self.piece = Memo(self._merged)
        self.first = Memo(lambda chunk: self._chunk(chunk))
        self.later = Memo(lambda chunk: self._chunk(" " + chunk))

    def _merged(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit numbers."""
        symbols = list(map(self.of_byte.__getitem__, piece.encode()))
        rank, made = self.rank.get, self.made
        # an entry of the queue is a rank, and below it the place of the pair's left symbol
        queue = [r << 32 | i for i, r in enumerate(map(rank, zip(symbols, symbols[1:]))) if r is not None]
        if queue:
            n = len(symbols)
            before, after = list(range(-1, n)), list(range(1, n + 2))  # place n ends the list
            symbols.append(-1)
            heapify(queue)
            while queue:
                entry = heappop(queue)
                i, r = entry & 0xFFFFFFFF, entry >> 32
                j = after[i]
                if rank((symbols[i], symbols[j])) != r:
                    continue  # stale: a neighbour has been merged since
                symbols[i], symbols[j] = made[r], -1
                k = after[i] = after[j]
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heappush(queue, r << 32 | i)
                h = before[i]
                if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                    heappush(queue, r << 32 | h)
            symbols = [x for x in symbols if x >= 0]
        return pack(f"<{len(symbols)}I", *symbols)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, PIECES.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        if RUN_OF_BLANKS.search(text):
            return self._chunk(text)
        head, *rest = text.split(" ")  # every other blank starts a piece, so the parts are independent
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if self.added_at is None or not self.added_at.search(text):
            return self._plain(text)
        return b"".join(np.array([self.added[part]], "<u4").tobytes() if part in self.added else self._plain(part) for part in self.added_at.split(text) if part)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class FastEncoder(BytePairCodec):
    """The same ids from the compiled merges of another library, where the vocabulary numbers its tokens in the order of the merges."""

    def __init__(self, spec: bytes):
        import tiktoken

        super().__init__(spec)
        added = set(self.added.values())
        ranks = {token: i for i, token in enumerate(self.strings) if token and i not in added}
        self.compiled = tiktoken.Encoding("own", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={}) if self.made == sorted(self.made) else None
        if self.compiled is not None:
            self.rank, self.made, self.decimals = {}, [], []

    def _plain(self, text: str) -> bytes:
        if self.compiled is None:
            return super()._plain(text)
        try:
            return self._compiled(text)
        except ValueError:  # the compiled pattern's stack is too small for some 10 ** 6 blanks in a row: such runs are cut out
            parts, at = [], 0
            for run in LONG_BLANKS.finditer(text):
                end = run.end() - (run.end() < len(text))  # the last blank goes with what follows
                parts += [self._compiled(text[at : run.start()]), np.array(self.compiled._encode_single_piece(text[run.start() : end]), "<u4").tobytes()]
                at = end
            return b"".join((*parts, self._compiled(text[at:])))

    def _compiled(self, text: str) -> bytes:
        return np.asarray(self.compiled.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


@lru_cache(maxsize=2)
def fast_encoder(spec: bytes) -> FastEncoder:
    return FastEncoder(spec)


@lru_cache(maxsize=2)
def codec(spec: bytes) -> BytePairCodec:
    return BytePairCodec(spec)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (of fixed size) for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the text that decoding gives), for every whole text.

    A null text counts as empty (no ids, empty text); rows with a null or repeated doc_id are
    encoded like any other, one output row for each; an empty table gives an empty one; columns
    other than doc_id and text are ignored. Memory is bounded by a block of texts and a bounded memo.
    """
    return _over(docs, vocabulary_path, "doc_id long, ids array<int>, decoded string", lambda c, raw: (np.frombuffer(raw, "<u4").astype("i4"), c.decode(np.frombuffer(raw, "<u4").tolist())), [pa.list_(pa.int32()), pa.string()])


def roundtrip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """As encode(), with digests in the place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def digest(c: BytePairCodec, raw: bytes):
        ids = np.frombuffer(raw, "<u4").tolist()
        return len(ids), hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    return _over(docs, vocabulary_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _over(docs: DataFrame, path: str, schema: str, of, kinds: list) -> DataFrame:
    spec = vocabulary(docs.sparkSession, path)
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for ids, texts in rows_of(batches):
            columns = list(zip(*(of(c, c.encode(text)) for text in texts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(x), kind) for x, kind in zip(columns, kinds))], names=names)

    return documents(docs).mapInArrow(run, schema)
