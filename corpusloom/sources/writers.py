"""Sinks: JSON lines, CSV, Parquet, small reports, and profiles of a split."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8, not escaped to ASCII."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Arrays, maps and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Partitioned by columns; a run that is repeated replaces only the partitions that it writes."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def report(rows: list[dict] | dict | str, path: str, spark: SparkSession | None = None) -> None:
    """A small result as pretty JSON, or a text as it is; with a session by Spark's file systems, so that the place may be a shared one."""
    shown = rows if isinstance(rows, str) else json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    if spark is None:
        Path(path).write_text(shown, encoding="utf-8")
        return
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(shown, "utf-8"))
    finally:
        out.close()


def files(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """A file in the folder for each row, with the text, under the row's name (which may have folders), written by the tasks that have the rows. A file is
    renamed when it is whole; of equal names one stays. Gives the number of rows."""
    store, path = fs.FileSystem.from_uri(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for own, content in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                place = f"{path}/{own}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                new = f"{place.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(new) as out:
                    out.write(content.encode())
                store.move(new, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    store.create_dir(path, recursive=True)
    return df.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def profile(df: DataFrame, name: str) -> dict:
    """Rows, columns with types, and a first row of a split."""
    first = df.limit(1).collect()
    return {"split": name, "num_samples": df.count(), "features": dict(df.dtypes), "sample": first[0].asDict(True) if first else None}


def summary(splits: dict[str, DataFrame]) -> dict:
    made = [profile(df, name) for name, df in splits.items()]
    return {"splits": made, "total": sum(p["num_samples"] for p in made)}
