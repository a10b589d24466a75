"""The stateless corpus steps on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import corpus


def cleaned(rows: DataFrame, column: str = "completion", threshold: int = 10) -> DataFrame:
    """Early spans removed, balanced and tagged rows only; the same expressions serve batches and streams."""
    early = rows.withColumn(column, tags.remove_early(F.col(column), threshold)["text"])
    return corpus.tagged(corpus.balanced(early, column), column)


def from_files(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return cleaned(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder))


def to_files(stream: DataFrame, folder: str, checkpoint: str):
    """Runs what there is and ends; the checkpoint makes a repeated run go on where it stopped."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
