"""Bloom filters of keys as tables (word, bits): built and merged by aggregates, asked by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (a power of two from 64 on): what is broadcast has an eighth of that in bytes. Some 800,000 keys leave 1 % of others unsure; more keys leave more.
BITS, HASHES = 1 << 23, 7


def _place(key: str, i: int, bits: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(i)).bitwiseAND(F.lit(bits - 1))


def build(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """word, bits of all keys; of bounded size, so that it may be written and merged with that of later keys."""
    if bits < 64 or bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*(_place(key, i, bits) for i in range(HASHES)))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """Of filters with the same number of bits."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def split(df: DataFrame, key: str, words: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key surely isn't among the filter's, and those whose key may be; null keys surely aren't."""
    every = df.sparkSession.range(bits // 64).withColumnRenamed("id", "word")  # in one row at the end: bits / 8 bytes
    row = every.join(words, "word", "left").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("__words"))
    held = lambda i: F.call_function("shiftright", F.get("__words", F.shiftright(_place(key, i, bits), 6).cast("int")), (_place(key, i, bits) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    may = F.col(key).isNotNull()
    for i in range(HASHES):
        may = may & held(i)
    met = df.crossJoin(F.broadcast(row))
    return met.where(~may).drop("__words"), met.where(may).drop("__words")
