"""A data source of JSON records in files of any layout: an array, a lone object over lines, or an object a line, each file told by itself.

    register(spark)
    spark.read.format("json_records").schema("id long, file_name string, _corrupt_record string").option("glob", "*.json").load(folder)

Columns named file_name and file_path tell where a record is from; with a column _corrupt_record what is malformed comes too, as its text and
without other values, else it is left out. Small files share a task, each file is read by one; of an array a record at a time is held.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType

NAME, PATH, CORRUPT = "file_name", "file_path", "_corrupt_record"
#: Bytes that files of one task have together, about, and bytes that are read at a time.
TASK_BYTES, CHUNK = 64 << 20, 1 << 20
#: What may stand before a file's first record.
BLANK = "\ufeff \t\r\n"
#: Characters of malformed text that are kept.
SHOWN = 10_000


def fitted(value, kind: DataType):
    """A JSON value as one of the column's type; another kind of value raises an error."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (LongType, IntegerType)) and isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << (63 if isinstance(kind, LongType) else 31):
        return value
    if isinstance(kind, (DoubleType, FloatType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [fitted(x, kind.elementType) for x in value]
    if isinstance(kind, MapType) and isinstance(value, dict):
        return {k: fitted(x, kind.valueType) for k, x in value.items()}
    if isinstance(kind, StructType) and isinstance(value, dict):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind.fields)
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


def _value(text: str) -> tuple[object, bool]:
    """The value of a JSON text, and whether it is one."""
    try:
        return json.loads(text), True
    except ValueError:
        return None, False


def records(chunks: Iterator[str]) -> Iterator[tuple[object, str | None]]:
    """(record, None) or (None, malformed text) of one file. A file that begins with an object in its first line, or is no JSON as a whole,
    is one of lines, of which each malformed one goes alone; from a malformed place of an array on the rest is one."""
    decoder, text, ended = json.JSONDecoder(), "", False

    def more(text: str) -> tuple[str, bool]:
        wanted = max(CHUNK, len(text))  # twice as much each time, so that a long record is not begun too often
        parts, got = [text], 0
        for chunk in chunks:
            parts.append(chunk)
            got += len(chunk)
            if got >= wanted:
                return "".join(parts), False
        return "".join(parts), True

    while not text.strip(BLANK) and not ended:
        text, ended = more(text)
    text = text.lstrip(BLANK)
    if not text:
        return
    while "\n" not in text and not ended:
        text, ended = more(text)
    if not text.startswith("["):
        if not isinstance(_value(text.split("\n", 1)[0])[0], dict):
            while not ended:
                text, ended = more(text)
            value, sound = _value(text)
            if sound:
                yield value, None
                return
        while True:
            head, cut, rest = text.partition("\n")
            if not cut and not ended:
                text, ended = more(text)
                continue
            if head.strip():
                value = _value(head)[0]
                yield (value, None) if isinstance(value, dict) else (None, head)
            if not cut:
                return
            text = rest
    text = text[1:]
    while True:
        text = text.lstrip(" \t\r\n,")
        if text.startswith("]"):
            return
        try:
            value, end = decoder.raw_decode(text)
            whole = end < len(text) or ended
        except ValueError:
            whole = False
            if ended:
                yield None, text
                return
        if whole:
            yield value, None
            text = text[end:]
        else:
            text, ended = more(text)


@dataclass
class Files(InputPartition):
    paths: list[str]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.kinds = dict(options), schema

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])

    def partitions(self) -> list[InputPartition]:
        """The files of all levels of the folder whose names fit; those under names that begin with a point or an underscore are none."""
        store, path = self._store()
        top = store.get_file_info(path)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        inner = lambda f: f.path.removeprefix(path).strip("/").split("/")
        files = sorted((f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.options.get("glob", "*")) and not any(x.startswith((".", "_")) for x in inner(f))), key=lambda f: f.path)
        out: list[Files] = []
        size = TASK_BYTES
        for f in files:
            if size + f.size > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        corrupt = CORRUPT in self.kinds.names
        for path in partition.paths:
            with store.open_input_stream(path) as raw:
                for value, malformed in records(_decoded(raw)):
                    told = {NAME: path.rsplit("/", 1)[-1], PATH: path}
                    if malformed is None:
                        try:
                            if not isinstance(value, dict):
                                raise ValueError("no object")
                            told |= {f.name: fitted(value.get(f.name), f.dataType) for f in self.kinds.fields if f.name not in (NAME, PATH, CORRUPT)}
                        except ValueError:
                            malformed = json.dumps(value, ensure_ascii=False)
                    if malformed is None:
                        yield tuple(told.get(n) for n in self.kinds.names)
                    elif corrupt:
                        told[CORRUPT] = malformed[:SHOWN]
                        yield tuple(told.get(n) for n in self.kinds.names)


def _decoded(raw) -> Iterator[str]:
    """The stream as UTF-8, a chunk at a time; other bytes are replaced."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while chunk := raw.read(CHUNK):
        yield decoder.decode(chunk)
    yield decoder.decode(b"", True)


class JsonRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> StructType:
        raise ValueError("json_records needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonRecords)
