"""Spelling variants of a corpus' words: letter-parity masks in three bands bring words of one edit together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many occurrences loses a letter; 0: none.
SLIPS = 199
#: Bits of a band; a letter's band is its code point modulo 3, which parts the vowels and the frequent consonants.
BITS = 21


def words(docs: DataFrame, slips: int = SLIPS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word: every occurrence, in whole texts, of a run of letters of at least `least_length`, A-Z lower-cased; a seeded `slips`-th of them without one letter."""
    text = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), UPPER, LOWER)
    own = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    if not slips:
        return own.select(F.col("run").alias("word"))
    told = own.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return told.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)


def _masked(vocabulary: DataFrame) -> DataFrame:
    """word, n, length, and mask: a bit for each letter (some rare ones share one) that is set if the letter occurs an odd number of times."""
    bit = lambda c: (F.ascii(c) % 3) * BITS + F.floor(F.ascii(c) / 3).cast("int") % BITS
    flip = lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int")))
    mask = F.aggregate(F.filter(F.split("word", ""), lambda c: c != ""), F.lit(0).cast("long"), flip)
    return vocabulary.select("word", "n", F.length("word").alias("length"), mask.alias("mask"))


def near_pairs(masked: DataFrame) -> DataFrame:
    """word, n, word2, n2: each pair of words of exactly one inserted, deleted or replaced code point once.

    An edit flips two bits of the mask at most, so that one band of three stays as it is: words of one length meet by (length, band) and are
    taken at their first equal band. An inserted letter flips one bit exactly, so that two bands stay: words of lengths that differ by one
    meet by both. Each word has twelve keys, which Spark doesn't reckon when it sizes a table for a broadcast: it is told to merge. As frequent letters crowd the bands, their groups are parted by a half of the word too, which the edit leaves alone:
    for each band words meet once by the first and once by the second half (of the shorter word's length). The rest is checked within the join."""
    ones = (1 << BITS) - 1
    length = F.col("length")

    def keys(longer: int):
        """For each kind (inserted or not, band, half): its number, the shorter word's length, the bits that stay, and the half."""
        out = []
        for inserted in (0, 1):
            size = length - longer * inserted
            first = F.floor(size / 2).cast("int")
            halves = (F.substring(F.col("word"), F.lit(1), first), F.substring(F.col("word"), length - (size - first) + 1, size - first))
            for k in range(3):
                kept = ones << BITS * k if not inserted else ((1 << 3 * BITS) - 1) ^ (ones << BITS * k)
                out += [F.struct(F.lit(6 * inserted + 2 * k + i).alias("kind"), size.alias("size"), F.col("mask").bitwiseAND(F.lit(kept).cast("long")).alias("bits"), half.alias("half")) for i, half in enumerate(halves)]
        return F.explode(F.array(*out)).alias("key")

    names = ["word", "n", "mask"]
    side = lambda longer, more: masked.select(keys(longer), *(F.col(c).alias(c + more) for c in names)).select("key.*", *(c + more for c in names))
    flipped = F.col("mask").bitwiseXOR(F.col("mask2"))
    same = lambda k: flipped.bitwiseAND(F.lit(ones << BITS * k).cast("long")) == 0
    band = F.when(F.col("kind") >= 4, ~same(0) & ~same(1)).when(F.col("kind") >= 2, ~same(0)).otherwise(True)
    first = F.floor(F.col("size") / 2).cast("int")
    once = (F.col("kind") % 2 == 0) | (F.substring(F.col("word"), F.lit(1), first) != F.substring(F.col("word2"), F.lit(1), first))
    fits = F.when(F.col("kind") < 6, (F.col("word") < F.col("word2")) & F.bit_count(flipped).isin(0, 2) & band).otherwise((F.bit_count(flipped) == 1) & once)
    met = side(0, "").join(side(1, "2").hint("merge"), ["kind", "size", "bits", "half"]).where(fits & (F.levenshtein("word", "word2", 1) == 1))
    return met.select("word", "n", "word2", "n2")


def variants(docs: DataFrame, slips: int = SLIPS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `least_count` occurrences.

    form: the near word (of one edit) of most occurrences, ties to the first in code-point order, if it has at least `ratio` times (more than
    1) those of the word, else null; root: the end of the chain of forms, the word itself if it has none. A null text has no words; a null
    doc_id counts as an empty string where slips are dealt; repeated rows count each; an empty table gives no rows; other columns are
    ignored. Occurrences are summed map-side first; chains end, as each step has `ratio` times the occurrences."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    with Scratch(docs.sparkSession) as scratch:
        counted = words(docs, slips, least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
        masked = scratch.written(_masked(counted), "words")
        pairs = scratch.written(near_pairs(masked), "pairs")
        both = pairs.unionByName(pairs.select(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word").alias("word2"), F.col("n").alias("n2")))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n2")).alias("less"), "word2")).alias("best"))
        best = best.select("word", "n_near", F.col("best.word2").alias("form"), (-F.col("best.less")).alias("form_n"))
        takes = F.col("form_n") >= ratio * F.col("n")
        told = masked.select("word", "n").join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
        told = scratch.written(told, "forms")
        roots, turn = told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
        while True:  # each turn doubles the steps taken
            ahead = roots.select(F.col("word").alias("via"), F.col("root").alias("on"))
            moved = scratch.written(roots.join(ahead.hint("merge"), F.col("root") == F.col("via"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), f"roots{turn}")
            roots, turn = moved.select("word", "root"), turn + 1
            if not moved.where("moved").limit(1).count():
                break
        out = told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "variants")
