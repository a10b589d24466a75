"""Inline reasoning spans <Tag>…</Tag>: counts, removal, balance and order, as column expressions; the tag is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, words

TAG = "ToW"


def opening(tag: str = TAG) -> str:
    return f"<{tag}>"


def closing(tag: str = TAG) -> str:
    return f"</{tag}>"


def _count(text: Column, literal: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(re.escape(literal)))


def opens(text: Column, tag: str = TAG) -> Column:
    return _count(text, opening(tag))


def closes(text: Column, tag: str = TAG) -> Column:
    return _count(text, closing(tag))


def blocks(text: Column, tag: str = TAG) -> Column:
    """Complete spans."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?s){opening(tag)}.*?{closing(tag)}"))


def strip(text: Column, tag: str = TAG) -> Column:
    """Without complete spans, over lines too; unclosed tags stay."""
    return F.regexp_replace(text, f"(?s){opening(tag)}.*?{closing(tag)}", "")


def strip_squeezed(text: Column, tag: str = TAG) -> Column:
    return squeeze(strip(text, tag))


def words_before(text: Column, tag: str = TAG) -> Column:
    """Words before the first opening tag; all words without one."""
    return words(F.substring_index(text, opening(tag), 1))


def remove_early(text: Column, threshold: int = 10, tag: str = TAG) -> Column:
    """struct(text, removed): while at most `threshold` words stand before the first span, it goes (the bare tag if unclosed)."""
    a, b = opening(tag), closing(tag)

    def step(state: Column, _: Column) -> Column:
        t = state["text"]
        at = F.instr(t, a)
        head = F.substring(t, F.lit(1), at - 1)
        rest = F.substring(t, at + len(a), F.length(t))
        end = F.instr(rest, b)
        tail = F.when(end > 0, F.substring(rest, end + len(b), F.length(rest))).otherwise(rest)
        early = (at > 0) & (words(head) <= threshold)
        made = lambda text, n, done: F.struct(text.alias("text"), n.cast("int").alias("removed"), F.lit(done).alias("done"))
        return F.when(state["done"], state).when(early, made(F.concat(head, tail), state["removed"] + 1, False)).otherwise(made(t, state["removed"], True))

    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).cast("int").alias("removed"), F.lit(False).alias("done"))
    return F.aggregate(F.array_repeat(F.lit(0), opens(text, tag)), start, step, lambda s: F.struct(squeeze(s["text"]).alias("text"), s["removed"].alias("removed")))


def is_balanced(text: Column, tag: str = TAG) -> Column:
    return opens(text, tag) == closes(text, tag)


def issues(text: Column, tag: str = TAG) -> Column:
    """What is wrong with the balance, as strings."""
    o, c, n = opens(text, tag), closes(text, tag), blocks(text, tag)
    say = lambda k, what: F.concat(F.lit("Missing "), k.cast("string"), F.lit(f" {what} tags"))
    told = F.array(
        F.when(o > c, say(o - c, "closing")),
        F.when(c > o, say(c - o, "opening")),
        F.when(n != F.least(o, c), F.concat(F.lit("Found "), o.cast("string"), F.lit(" opening tags, "), c.cast("string"), F.lit(" closing tags, but only "), n.cast("string"), F.lit(" complete blocks"))),
    )
    return F.filter(told, lambda x: x.isNotNull())


def sequence(text: Column, tag: str = TAG) -> Column:
    """The tags in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"</?{tag}>"), F.lit(0))


def positions(text: Column, tag: str = TAG) -> Column:
    """array<struct(kind, start, end)> of the tags in order (from 0)."""
    both = F.split(F.coalesce(text, F.lit("")), f"(?=</?{tag}>)|(?<=</?{tag}>)")

    def step(state: Column, part: Column) -> Column:
        kind = F.when(part == opening(tag), "open").when(part == closing(tag), "close")
        end = (state["at"] + F.length(part)).cast("int")
        found = F.when(kind.isNotNull(), F.concat(state["found"], F.array(F.struct(kind.alias("kind"), state["at"].alias("start"), end.alias("end"))))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.aggregate(both, F.struct(F.lit(0).cast("int").alias("at"), none.alias("found")), step, lambda s: s["found"])


def patterns(text: Column, tag: str = TAG) -> Column:
    """Labels of texts with more opening than closing tags: how they are unbalanced."""
    seq, o, c = sequence(text, tag), opens(text, tag), closes(text, tag)
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")
    run = F.aggregate(
        seq,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, t: F.struct(F.when(t == opening(tag), s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(t == opening(tag), s["now"] + 1).otherwise(0)).alias("most")),
        lambda s: s["most"],
    )
    told = F.array(
        F.when(bare.endswith(opening(tag)), "ENDS_WITH_OPEN_TOW"),
        F.when(F.try_element_at(seq, F.lit(-1)) == opening(tag), "LAST_TOW_UNCLOSED"),
        F.when(run > 1, F.concat(F.lit("CONSECUTIVE_OPENS_"), run.cast("string"))),
    )
    return F.when(o > c, F.filter(told, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def unclosed_at_end(text: Column, tag: str = TAG) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "").endswith(opening(tag)) | F.contains(F.substring_index(text, closing(tag), -1), F.lit(opening(tag)))
