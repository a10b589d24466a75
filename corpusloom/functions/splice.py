"""Splicing reasoning into sentences at given words, and the contexts between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sub(text: Column, start: Column, length: Column | None = None) -> Column:
    """From start (counted from 0)."""
    return F.substring(text, start + 1, F.length(text) if length is None else F.greatest(length, F.lit(0)))


def word_positions(sentence: Column, gold: Column) -> Column:
    """array<struct(pos, idx, word)> of the first place of each word, in order; absent words are left out."""
    found = F.transform(gold, lambda w, i: F.struct((F.instr(sentence, w) - 1).alias("pos"), i.alias("idx"), w.alias("word")))
    return F.array_sort(F.filter(found, lambda x: x["pos"] >= 0))


def insert(sentence: Column, gold: Column, tows: Column) -> Column:
    """Each reasoning before its word; without words, or with unequal lists, the sentence as it is.

    Overlapping words repeat text, as the place reached may lie behind the next word.
    """
    step = lambda s, x: F.struct(
        F.concat(s["out"], _sub(sentence, s["at"], x["pos"] - s["at"]), F.get(tows, x["idx"]), x["word"]).alias("out"), (x["pos"] + F.length(x["word"])).cast("int").alias("at")
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))
    spliced = F.aggregate(word_positions(sentence, gold), start, step, lambda s: F.concat(s["out"], _sub(sentence, s["at"])))
    usable = gold.isNotNull() & tows.isNotNull() & (F.size(gold) > 0) & (F.size(gold) == F.size(tows))
    return F.when(usable, spliced).otherwise(sentence)


def insert_one(sentence: Column, word: Column, tow: Column) -> Column:
    """Before the first place of one word; null where it is absent."""
    at = F.instr(sentence, word)
    return F.when(at > 0, F.concat(F.substring(sentence, F.lit(1), at - 1), tow, F.substring(sentence, at, F.length(sentence))))


def valid_words(sentence: Column, gold: Column) -> Column:
    return F.filter(gold, lambda w: F.instr(sentence, w) > 0)


def context_before(sentence: Column, gold: Column) -> Column:
    """Text before the first valid word, trimmed; null where it is empty."""
    first = F.try_element_at(valid_words(sentence, gold), F.lit(1))
    return F.nullif(F.trim(F.substring(sentence, F.lit(1), F.instr(sentence, first) - 1)), F.lit(""))


def text_between(sentence: Column, word: Column, following: Column) -> Column:
    """After the first place of a word up to the next one's; to the end where there is none; '' where the word is absent."""
    at = F.instr(sentence, word)
    rest = F.substring(sentence, at + F.length(word), F.length(sentence))
    nearer = F.instr(rest, following)
    return F.when(at <= 0, "").when(nearer > 0, F.substring(rest, F.lit(1), nearer - 1)).otherwise(rest)


def contexts(sentence: Column, context: Column, gold: Column, tows: Column) -> Column:
    """The context that each word is reasoned about in: the one before it, its reasoning and the word after a blank each, and the text up to the next."""

    def step(s: Column, i: Column) -> Column:
        now, word = s["now"], F.get(gold, i)
        grown = F.concat(now, F.lit(" "), F.get(tows, i), F.lit(" "), word, text_between(sentence, word, F.get(gold, i + 1)))
        return F.struct(grown.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

    start = F.struct(context.alias("now"), F.array().cast("array<string>").alias("all"))
    places = F.filter(F.sequence(F.lit(0), F.size(gold)), lambda i: i < F.size(gold))
    return F.aggregate(places, start, step, lambda s: s["all"])


def key_words(output: Column) -> Column:
    """The words of a {"key_word": […] or "…"} fragment in a text; null without one."""
    fragment = F.regexp_extract(output, r'(?s)(\{\s*"key_word"\s*:\s*(?:\[.*?\]|".*?")\s*\})', 1)
    many = F.from_json(fragment, "key_word array<string>")["key_word"]
    one = F.from_json(fragment, "key_word string")["key_word"]
    return F.coalesce(many, F.when((fragment != "") & one.isNotNull() & ~one.startswith("["), F.array(one)))
