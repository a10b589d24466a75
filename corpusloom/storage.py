"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the write that needed them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one
    for a local master; other masters raise, as their executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. For results, which stay until the folder is cleared; steps on the way belong to a Scratch."""
    return _write(df, fresh(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that go when the block ends; `free` drops one that is of no more use before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, fresh(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.top)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.top}/{name}")

    def free(self, name: str) -> None:
        self._delete(f"{self.top}/{name}")

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
