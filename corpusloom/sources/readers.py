"""Readers of JSON arrays, JSON lines, Parquet, CSV and text with declared schemas and provenance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import records

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: StructType | str, spark: SparkSession) -> StructType:
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType([*s.fields, StructField(CORRUPT, StringType())])


def _sound(df: DataFrame) -> DataFrame:
    """Without malformed records. Spark only parses a record if a column of it is asked for, so that the hash, which is
    never below the least number, is part of the condition."""
    own = [c for c in df.columns if c != CORRUPT]
    return df.where(F.col(CORRUPT).isNull() & (F.hash(*own) >= F.lit(-(1 << 31)))).drop(CORRUPT)


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One object a line; blank and malformed lines are skipped."""
    return _sound(spark.read.schema(_with_corrupt(schema, spark)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _records(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*", source: str | None = None) -> DataFrame:
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records.register(spark)
    df = spark.read.format("json_records").schema(StructType([*own.fields, *([StructField(records.NAME, StringType())] if source else [])])).option("glob", glob).load(path)
    return df.withColumnRenamed(records.NAME, source) if source else df


def json_arrays(spark: SparkSession, path: str, schema: StructType | str, source: str = "source_file") -> DataFrame:
    """The records of all JSON files of a folder with the file's name; what is malformed is left out."""
    return _records(spark, path, schema, "*.json", source)


def json_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files of an array, a lone object over lines, or an object a line, each told by itself; malformed records are left out."""
    return _records(spark, path, schema)


def malformed(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """file_name, text of what the readers above leave out."""
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    more = [StructField(records.NAME, StringType()), StructField(records.CORRUPT, StringType())]
    records.register(spark)
    df = spark.read.format("json_records").schema(StructType([*own.fields, *more])).option("glob", glob).load(path)
    return df.where(F.col(records.CORRUPT).isNotNull()).select(records.NAME, F.col(records.CORRUPT).alias("text"))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upload(spark: SparkSession, path: str) -> DataFrame:
    """text, language of a CSV, a JSON list or a plain text (one row, language en); a missing column raises an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.lit("en").alias("language"))
    df = spark.read.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.json(path, multiLine=True)
    if missing := {"text", "language"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select("text", "language")


#: Names of the language-understanding tasks.
TASKS = ("tc", "sts", "nli", "ner", "re", "dp", "mrc", "dst")


def task(spark: SparkSession, folder: str, name: str, split: str = "validation") -> DataFrame:
    """A task's split from a local copy, Parquet or JSON lines."""
    if name not in TASKS:
        raise ValueError(f"unknown task {name}")
    tables = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{split}")
    if tables.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(tables):
        return spark.read.parquet(f"{folder}/{name}/{split}")
    return spark.read.json(f"{folder}/{name}_{split}.json")


def results(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """Result files of all levels of a folder, without malformed ones, with the file's name and the kind that its name shows."""
    name = F.col("file_name")
    kind = F.when(name.contains("klue_benchmark_results.json"), "benchmark").when(name.contains("_results.json"), "task").when(name.contains("_summary.json"), "summary").otherwise("other")
    return _records(spark, folder, schema, pattern, "file_name").withColumn("kind", kind)


def details(df: DataFrame) -> DataFrame:
    """datasets.<name>.details[] -> a flat row for each detail; datasets is a map of structs with an array details."""
    return df.select(*[c for c in df.columns if c != "datasets"], F.explode("datasets").alias("dataset", "__d")).select("*", F.posexplode("__d.details").alias("pos", "__x")).drop("__d").select("*", "__x.*").drop("__x")


def config(path: str) -> dict:
    """A YAML tree (of mappings, lists and scalars; the safe subset, without further libraries)."""
    try:
        import yaml
    except ImportError:
        with open(path, encoding="utf-8") as f:
            return _tree([(len(x) - len(x.lstrip()), x.strip()) for x in f.read().splitlines() if x.strip() and not x.lstrip().startswith("#")])
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _scalar(x: str):
    x = re.sub(r"\s+#.*$", "", x).strip()
    if re.fullmatch(r"-?\d+", x):
        return int(x)
    if re.fullmatch(r"-?\d*\.\d+(e-?\d+)?|-?\d+e-?\d+", x, re.IGNORECASE):
        return float(x)
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    return {"true": True, "false": False, "null": None, "": None}.get(x.lower(), x.strip("'\""))


def _tree(lines: list[tuple[int, str]]):
    if lines and lines[0][1].startswith("- "):
        return [_scalar(x[2:]) for _, x in lines]
    out: dict = {}
    i = 0
    while i < len(lines):
        depth, text = lines[i]
        key, _, value = text.partition(":")
        j = i + 1
        while j < len(lines) and lines[j][0] > depth:
            j += 1
        out[key.strip().strip("'\"")] = _tree(lines[i + 1 : j]) if j > i + 1 else _scalar(value)
        i = j
    return out


def dotted(tree: dict, key: str, default=None):
    for part in key.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree
