"""Token ids as files in the Arrow file format: batches of fixed-size lists, so that any sequence is a view at a computed place."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo, byte_letters, vocabulary
from .common import order_key, row_hash, rows_of

SEQUENCE, ROWS, END_ID = 2048, 1 << 16, 1
#: Sequences of one record batch (the last of a file may have fewer): what a writing task holds beside a block of texts.
BATCH = 256
#: Ids that a task holds at a time when documents are read back, a longer document comes whole.
HELD = 1 << 20
#: Fixed value: the pattern of pieces by which vocabularies with word ends cut a text; blanks are in none of them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin characters that no normalisation changes and that every edition of the character tables has; without the capital I with a dot.
PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
MANIFEST = "block int, file int, n_sequences long, n_tokens long, n_documents long"


class Encoder:
    """The library's ids of whole texts. Where the vocabulary drops blanks, texts are cut at them, plain parts into the pieces of the vocabulary's
    pattern too, and the library encodes what no bounded memo has."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.apart = blanks_dropped(json.loads(spec))
        self.cut, self.merged = regex.compile(PIECES).findall, self.library.model.tokenize
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.parts, self.pieces = Memo(self._part), Memo(self._piece)

    def _packed(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.kind.char}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Of a lower-cased piece: the library's merges alone, of the letters that stand for its bytes."""
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return self._packed([t.id for t in self.merged(piece)])

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            return self.pieces[part.lower()]
        if not PLAIN.fullmatch(part) or "<|" in part:
            return self._whole(part)
        return b"".join(map(self.pieces.__getitem__, self.cut(part.lower())))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" "))) if self.apart else self._whole(text)


def blanks_dropped(told: dict) -> bool:
    """Whether the vocabulary's rules are those under which the parts between blanks are independent of one another."""
    normal, cuts = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    first, *rest = cuts.get("pretokenizers") or [{}]
    own = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and bool(first.get("invert"))
    own = own and [r.get("type") for r in rest] == ["ByteLevel"] and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space")
    added = all(t["content"].startswith("<|") and not set(" \n") & set(t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens", []))
    return kinds == ["NFC", "Replace", "Lowercase"] and own and added and not told.get("post_processor")


@lru_cache(maxsize=2)
def encoder(spec: bytes) -> Encoder:
    return Encoder(spec)


def _schema(kind: np.dtype, sequence: int, rows: int, batch: int) -> pa.Schema:
    about = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("documents", about)], metadata={"sequences_of_a_file": str(rows), "sequences_of_a_batch": str(batch)})


def _name(block: int, file: int) -> str:
    return f"tokens-{block:06d}-{file:06d}.arrow"


class _Files:
    """The files of one block of documents: ids come in, full batches go out."""

    def __init__(self, folder: str, block: int, kind: np.dtype, sequence: int, rows: int, batch: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.block, self.kind, self.sequence, self.rows, self.batch = block, kind, sequence, rows, batch
        self.schema = _schema(kind, sequence, rows, batch)
        self.held: list[bytes] = []
        self.about: list[tuple] = []
        self.n_held = self.at = self.done = self.file = self.in_file = self.tokens = self.documents = 0
        self.sink = self.out = self.new = None

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // self.kind.itemsize
        self.about.append((doc_id, self.at, n))
        self.held.append(ids)
        self.at += n
        self.n_held += n
        if self.n_held >= self.batch * self.sequence:
            yield from self._flush(False)

    def _flush(self, last: bool) -> Iterator[tuple]:
        """Full batches (all, if it is the last time) to the file; the manifest's row of each file that is whole."""
        raw = np.frombuffer(b"".join(self.held), self.kind)
        at = 0
        while len(raw) - at >= self.batch * self.sequence or last and at < len(raw):
            n = min(self.batch, self.rows - self.in_file, -(-(len(raw) - at) // self.sequence))
            part = raw[at : at + n * self.sequence]
            at += len(part)
            self._write(part, n)
            if self.in_file == self.rows:
                yield self._close()
        self.held, self.n_held = [raw[at:].tobytes()], len(raw) - at

    def _write(self, part: np.ndarray, n: int) -> None:
        if self.out is None:
            self.new = f"{self.path}/.{uuid.uuid4().hex}"  # renamed when whole: an attempt that is lost leaves no half file of the name
            self.sink = self.store.open_output_stream(self.new)
            self.out = pa.ipc.new_file(self.sink, self.schema)
        wide = n * self.sequence
        ids, mask = np.zeros(wide, self.kind), np.zeros(wide, bool)
        ids[: len(part)], mask[: len(part)] = part, True
        begun = next((i for i, x in enumerate(self.about) if x[1] >= self.done + wide), len(self.about))
        about, self.about = self.about[:begun], self.about[begun:]
        bounds = np.searchsorted([x[1] - self.done for x in about], np.arange(n + 1) * self.sequence).astype("i4")
        inner = self.schema.field("documents").type.value_type
        told = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*about)) or [[], [], []])], fields=list(inner))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence), pa.ListArray.from_arrays(pa.array(bounds), told)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.done += len(part)
        self.in_file += n
        self.tokens += len(part)
        self.documents += len(about)

    def _close(self) -> tuple:
        self.out.close()
        self.sink.close()
        self.store.move(self.new, f"{self.path}/{_name(self.block, self.file)}")
        told = self.block, self.file, self.in_file, self.tokens, self.documents
        self.out, self.file, self.in_file, self.tokens, self.documents = None, self.file + 1, 0, 0, 0
        return told

    def finish(self) -> Iterator[tuple]:
        yield from self._flush(True)
        if self.out is not None:
            yield self._close()


def write(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, rows: int = ROWS, batch: int = BATCH) -> DataFrame:
    """Files in `folder` (of a store that all executors reach) with all texts' ids, each text's followed by `end_id`, in ascending doc_id order.

    Documents are dealt into blocks by ranges of doc_id, a task each, so that one shuffle of the texts is all. A block's ids are one stream, cut into sequences
    of `sequence` ids; a file has `rows` of them, and only a block's last sequence is padded (mask false; all other ids have mask true). Beside ids (16
    bits where the vocabulary has no more, else 32) and mask a row tells the documents that start in it: doc_id, start (in the block), n_tokens.
    Returns the manifest (block, file, n_sequences, n_tokens, n_documents), a table in the folder that is written last: without it the files
    aren't complete.

    A null text counts as empty (the end id alone); null doc_ids come last, rows of one doc_id by a hash of the text; an empty table
    gives no files; other columns are ignored. A task holds a block of texts and a record batch; a long document goes over several batches and files."""
    if not 0 <= end_id < 1 << 16 or min(sequence, rows, batch) < 1:
        raise ValueError("end_id must fit 16 bits; sequence, rows and batch must be positive")
    spark, spec = docs.sparkSession, vocabulary(docs.sparkSession, vocabulary_path)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value)
        files, end = _Files(folder, TaskContext.get().partitionId(), own.kind, sequence, rows, batch), np.array([end_id], own.kind).tobytes()
        told = []
        for doc_ids, texts in rows_of(batches):
            for doc_id, text in zip(doc_ids, texts):
                told += files.add(doc_id, own.encode(text) + end)
        told += files.finish()
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*told)) or [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), order_key(docs["doc_id"]).alias("d"), row_hash(docs["text"]).alias("row"))
    sorted_ = own.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("d", "row", "place").sortWithinPartitions("d", "row")
    sorted_.select("doc_id", "text").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Reader:
    """Sequences, masks and stretches of a block's stream, by place. On a local or mounted disk they are views of the mapped file: nothing is copied or read ahead.

    files: the manifest's rows, for which sequences are numbered through all blocks; without it only stretches and documents of blocks are there."""

    def __init__(self, folder: str, files: list | None = None):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.file = lru_cache(maxsize=4)(self._open)
        self.places, self.first, n = [], [], 0
        for r in sorted(files or [], key=lambda r: (r["block"], r["file"])):
            self.places.append((r["block"], r["file"]))
            self.first.append(n)
            n += r["n_sequences"]
        self.n_sequences = n

    def _open(self, block: int, file: int) -> list[pa.RecordBatch]:
        path = f"{self.path}/{_name(block, file)}"
        source = pa.memory_map(path) if isinstance(self.store, fs.LocalFileSystem) else self.store.open_input_file(path)
        opened = pa.ipc.open_file(source)
        return [opened.get_batch(i) for i in range(opened.num_record_batches)]

    def _row(self, column: str, i: int) -> pa.Array:
        if not 0 <= i < self.n_sequences:
            raise IndexError(i)
        at = bisect_right(self.first, i) - 1
        batches = self.file(*self.places[at])
        batch, row = divmod(i - self.first[at], int(batches[0].schema.metadata[b"sequences_of_a_batch"]))
        return batches[batch].column(column).slice(row, 1).flatten()

    def ids(self, i: int) -> np.ndarray:
        return self._row("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """A view of the bits."""
        return self._row("mask", i)

    def stretch(self, block: int, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a block from place `start` on, as views of one record batch at most."""
        schema = self.file(block, 0)[0].schema
        sequence = schema.field("ids").type.list_size
        size, wide = (int(schema.metadata[k]) * sequence for k in (b"sequences_of_a_file", b"sequences_of_a_batch"))
        while n:
            file, at = divmod(start, size)
            batch, at = divmod(at, wide)
            view = self.file(block, file)[batch].column("ids").flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield view
            start, n = start + len(view), n - len(view)

    def documents(self, block: int, file: int) -> Iterator[tuple]:
        """(doc_id, start, n_tokens) of those that start in a file."""
        for batch in self.file(block, file):
            told = batch.column("documents").flatten()
            yield from zip(*(told.field(k).to_pylist() for k in range(3)))


def _per_document(spark: SparkSession, folder: str, schema: str, of, kinds: list) -> DataFrame:
    """doc_id, start (in the stream of all blocks), n_tokens and what `of` makes of a document's views, for every document of the files."""
    before, n, number = [], 0, 0
    for r in manifest(spark, folder).groupBy("block").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("block").collect():  # a row a block
        before.append((r["block"], n))
        n, number = n + r["n"], number + r["files"]
    starts = spark.createDataFrame(before, "block int, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for block, file, ahead in zip(*(batch.column(c).to_pylist() for c in ("block", "file", "before"))):
                out: list[tuple] = []
                held = 0
                for doc_id, start, n in reader.documents(block, file):
                    out.append((doc_id, ahead + start, n, of(reader.stretch(block, start, n))))
                    held += n
                    if held >= HELD:
                        yield made(out)
                        out, held = [], 0
                if out:
                    yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), *kinds])], names=["doc_id", "start", "n_tokens", "told"])

    files = manifest(spark, folder).select("block", "file").repartition(max(1, number), "block", "file").join(F.broadcast(starts), "block")
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, told {schema}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document in the files, by random access."""
    return _per_document(spark, folder, "binary", lambda views: b"".join(x.astype("<u4").tobytes() for x in views), [pa.binary()]).withColumnRenamed("told", "ids")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), a view at a time, whatever a document's length."""

    def of(views: Iterator[np.ndarray]) -> int:
        crc = 0
        for x in views:
            crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
        return crc

    return _per_document(spark, folder, "long", of, [pa.int64()]).withColumnRenamed("told", "ids_crc32")
