"""The boundary to models: a generator runs on partitions, with a limit of calls over all of them; results are committed by batches and resumed."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.scoring import unprocessed

#: Attempts, first delay in seconds and its growth, calls at a time, mark of a failure.
ATTEMPTS, DELAY, GROWTH, AT_ONCE, FAILED = 5, 2.0, 3, 5, "[ERROR]"


def called(generate: Callable[[str], str], prompt: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    """The output, or a mark with the reason after the last attempt."""
    for i in range(attempts):
        try:
            return generate(prompt)
        except Exception as e:  # whatever a remote model raises
            why = e
            if i + 1 < attempts:
                sleep(DELAY * GROWTH**i + random.random())
    return f"{FAILED} {why}"


def _limited(df: DataFrame, at_once: int, in_all: int | None, *by: str) -> tuple[DataFrame, int]:
    """df in so few partitions, and so many calls a partition, that no more than `in_all` run over all executors (None: as many as there are partitions)."""
    if in_all is None:
        return (df.repartition(*by) if by else df), at_once
    if in_all < 1:
        raise ValueError("in_all must be positive")
    at_once = min(at_once, in_all)
    return df.repartition(in_all // at_once, *by), at_once


def _outputs(pool: ThreadPoolExecutor, generate: Callable[[str], str], prompts: Iterable[str], sleep: Callable[[float], None] = time.sleep) -> list[str]:
    return list(pool.map(lambda p: called(generate, p, sleep=sleep), prompts))


def run(df: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", output: str = "model_raw_output", at_once: int = AT_ONCE, batch: int = 16, in_all: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """df with an output column. make() builds the generator once a partition; a few calls run at a time, with `in_all` no more than that over all
    partitions. profile: what a task needs of its executor (as GPUs)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{output}` string"])
    df, at_once = _limited(df, at_once, in_all)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in frames:
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch].copy()
                    part[output] = _outputs(pool, generate, part[prompt])
                    yield part

    return df.mapInPandas(work, schema, profile=profile)


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What `saved` has committed in the folder, whatever became of the runs."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("batch-")]
    return spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def saved(wanted: DataFrame, folder: str, key: str, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", output: str = "model_raw_output", batch: int = 100, at_once: int = AT_ONCE, in_all: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """key and output of all wanted rows, each generated and saved once, also if runs before this one were killed half-way.

    Rows without a saved output are dealt by a hash of the key into batches of about `batch`. A task writes a batch to a file of no meaning and
    renames it when it is whole: the rename is the commit, its name (run and batch) is the same for every attempt, and an attempt that finds the name
    leaves the batch alone. What a killed run has committed stays; the next one asks for the rest under a run number of its own. Keys must be unique
    (of equal ones one counts); rows with a null key are left out; runs on one folder must not overlap."""
    spark = wanted.sparkSession
    kind = wanted.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, `{output}` string"
    store, path = fs.FileSystem.from_uri(folder)
    before = committed(spark, folder, schema)
    turn = 1 + max((int(f.base_name.split("-")[1]) for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("batch-")), default=0)
    left = unprocessed(wanted.where(F.col(key).isNotNull()).select(key, prompt), before, key).dropDuplicates([key])
    number = max(1, -(-left.count() // batch))
    rows, at_once = _limited(left.withColumn("__batch", F.pmod(F.xxhash64(key), F.lit(number))), at_once, in_all, "__batch")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate, held, own = make(), [], None
        store, path = fs.FileSystem.from_uri(folder)

        def commit(pool: ThreadPoolExecutor) -> Iterator[pd.DataFrame]:
            if held and store.get_file_info(name := f"{path}/batch-{turn:06d}-{own:09d}.parquet").type == fs.FileType.NotFound:
                part = pd.concat(held)
                table = pa.table({key: pa.array(part[key], to_arrow_type(kind)), output: pa.array(_outputs(pool, generate, part[prompt]), pa.string())})
                new = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(new) as out:
                    pq.write_table(table, out)
                store.move(new, name)
                yield pd.DataFrame({"batch": [own], "n": [len(part)]})

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in frames:
                for number, part in pdf.groupby("__batch", sort=False):
                    if number != own:
                        yield from commit(pool)
                        own, held = number, []
                    held.append(part)
            yield from commit(pool)

    rows.sortWithinPartitions("__batch").mapInPandas(work, "batch long, n long", profile=profile).agg(F.sum("n")).collect()
    return committed(spark, folder, schema)


def resumed(wanted: DataFrame, done: DataFrame | None, key: str, make: Callable[[], Callable[[str], str]], shard: int = 0, shards: int = 1, **more) -> DataFrame:
    """Only what is not done yet, and of it one shard of a number."""
    left = unprocessed(wanted, done, key) if done is not None else wanted
    return run(left.where(F.pmod(F.xxhash64(key), F.lit(shards)) == shard), make, **more)
