"""Chat rows, dataset mixing and training encodings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shuffled
from ..storage import written

#: Speaker names that conversations use, the instruction frame, and the chat markers.
ROLES = {"gpt": "assistant", "Assistant": "assistant", "assistant": "assistant", "user": "user", "User": "user", "human": "user"}
FRAME = ("Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n", "\n\n### Input:\n", "\n\n### Response:")
MARKS = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
MASK = -100
#: Ids that an encoding task holds at once.
IDS = 1 << 20


def _turn(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content.cast("string"), F.lit("")).alias("content"))


def _conversation(column: str) -> Column:
    roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    known = lambda c: F.coalesce(F.try_element_at(roles, c["from"]), F.raise_error(F.concat(F.lit("unknown role "), c["from"])))
    return F.transform(column, lambda c: F.struct(known(c).alias("role"), c["value"].alias("content")))


def to_messages(df: DataFrame) -> DataFrame:
    """A messages column from the columns there are; the first fitting layout of a fixed order counts, else df as it is."""
    have = set(df.columns)
    if "messages" in have:
        return df
    c = F.col
    layouts: list[tuple[set, Callable[[], Column]]] = [
        ({"instruction", "output"}, lambda: F.array(_turn("user", F.concat(F.lit(FRAME[0]), c("instruction"), F.lit(FRAME[1]), c("input") if "input" in have else F.lit(""), F.lit(FRAME[2]))), _turn("assistant", c("output")))),
        ({"prompt", "completion"}, lambda: F.array(_turn("user", c("prompt")), _turn("assistant", c("completion")))),
        ({"conversations"}, lambda: _conversation("conversations")),
        ({"question", "response"}, lambda: F.array(_turn("system", c("system_prompt") if "system_prompt" in have else F.lit("")), _turn("user", c("question")), _turn("assistant", c("response")))),
        ({"query", "answer"}, lambda: F.array(_turn("user", c("query")), _turn("assistant", c("answer")))),
        ({"query", "response"}, lambda: F.array(_turn("user", c("query")), _turn("assistant", c("response")))),
        ({"chosen", "rejected", "reference_completion"}, lambda: c("chosen")),
    ]
    return next((df.withColumn("messages", make()) for need, make in layouts if need <= have), df)


def is_chat(messages: Column) -> Column:
    return F.coalesce(F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def render(messages: Column, end: str = "</s>") -> Column:
    """One text with role markers; empty lists and unknown roles raise an error."""
    marks = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    one = lambda m: F.concat(F.coalesce(F.try_element_at(marks, m["role"]), F.raise_error(F.concat(F.lit("no mark for the role "), m["role"]))), F.trim(m["content"]), F.when(m["role"] == "assistant", end).otherwise(""), F.lit("\n"))
    return F.when(F.size(messages) == 0, F.raise_error(F.lit("a conversation without turns"))).otherwise(F.trim(F.array_join(F.transform(messages, one), "")))


def parse_mixer(items: list) -> dict[str, float | int]:
    """[name, value, …]: a value with a point is a fraction, else a count."""
    return {name: float(v) if "." in str(v) else int(v) for name, v in zip(items[::2], items[1::2])}


def mix(sources: dict[str, DataFrame], shares: dict[str, float | int], key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """A seeded shuffle's prefix of each source, by count if any value is above 1, else by fraction. Exact numbers, no global sort:
    rows are ordered by a hash of seed and key, and only the bucket of hashes that holds the boundary is ranked."""
    if any(v < 0 for v in shares.values()):
        raise ValueError("shares must not be negative")
    counts = any(v > 1 for v in shares.values())
    if counts and any(isinstance(v, float) and v <= 1 and v != int(v) for v in shares.values()):
        raise NotImplementedError("fractions and counts can't be mixed")
    out = None
    for name, df in sources.items():
        missing = set(columns) - set(df.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        part = _prefix(df, shares[name], key, seed, counts).select(*columns).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _prefix(df: DataFrame, share: float | int, key: str, seed: int, counts: bool) -> DataFrame:
    hashed = df.withColumn("__h", shuffled(F.col(key), seed)).withColumn("__b", F.shiftright("__h", 44))
    sizes = hashed.groupBy("__b").agg(F.count("*").alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__b")))  # 65,536 rows at most
    want = F.lit(int(share)).cast("long") if counts else F.floor(F.lit(float(share)) * F.sum("n").over(Window.partitionBy(F.lit(0))))
    room = upto.select("__b", (want - (F.col("upto") - F.col("n"))).alias("room")).where("room > 0")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return hashed.join(F.broadcast(room), "__b").withColumn("__r", rank).where(F.col("__r") <= F.col("room"))


def numbered(df: DataFrame, order: Column, name: str = "index") -> DataFrame:
    """df with each row's place (from 0) in an order of any type; equal ones, and nulls (first), in any order."""
    return _numbered(df, order, name)[0]


def _numbered(df: DataFrame, order: Column, name: str) -> tuple[DataFrame, int]:
    """The numbered rows and how many they are. Rows are dealt out by ranges of the order (equal ones part too), sorted in each range and written
    once with their place in it; the number of rows of each range (one row a range) then gives the first place of the next."""
    keyed = df.select("*", order.alias("__o")).withColumn("__tie", F.monotonically_increasing_id())
    sorted_ = keyed.repartitionByRange("__o", "__tie").sortWithinPartitions("__o", "__tie").drop("__o", "__tie").withColumn("__at", F.monotonically_increasing_id())
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))  # the low 33 bits count a range's rows, the others tell the range
    rows = written(sorted_, "numbered").withColumn("__range", F.shiftright("__at", 33))
    before, n = [], 0
    for r in rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        before.append((r["__range"], n))
        n += r["n"]
    starts = df.sparkSession.createDataFrame(before, "__range long, __before long")
    return rows.join(F.broadcast(starts), "__range").withColumn(name, at + F.col("__before")).drop("__range", "__at", "__before"), n


def synthetic_ids(df: DataFrame, name: str, split: str, order: Column) -> DataFrame:
    """id: name, the place in the order, and the split; a table that has ids keeps them."""
    if "id" in df.columns:
        return df
    return numbered(df, order, "__i").withColumn("id", F.concat_ws("_", F.lit(name), F.col("__i").cast("string"), F.lit(split))).drop("__i")


def combine(sources: dict[str, DataFrame], shares: dict[str, float | int], split: str, key: str, columns: list[str], shuffle: bool = False, seed: int = 42) -> DataFrame:
    """id and the columns of the first rows of each dataset, by its key (of any type that has an order) or a seeded order: a share above 1 counts rows, others are fractions."""
    if any(v < 0 for v in shares.values()):
        raise ValueError("shares must not be negative")
    out = None
    for name, df in sources.items():
        placed, n = _numbered(df, shuffled(F.col(key), seed) if shuffle else F.col(key), "__place")
        placed = placed.where(F.col("__place") < int(shares[name] if shares[name] > 1 else shares[name] * n))
        if "id" not in df.columns:
            placed = placed.withColumn("id", F.concat_ws("_", F.lit(name), F.col("__place").cast("string"), F.lit(split)))
        part = placed.select("id", *columns)
        out = part if out is None else out.unionByName(part)
    return out


def joined(prompt: Column, completion: Column, end: str = "</s>") -> Column:
    """prompt + completion + end, with a blank only where neither side has one at the seam."""
    blank = r"^\s|^$"
    return F.concat(prompt, F.when(prompt.rlike(r"\s$") | (prompt == "") | completion.rlike(blank), "").otherwise(" "), completion, F.lit(end))


def _in_parts(frames: Iterator[pd.DataFrame], columns: list[str], make: Callable[..., tuple[list[int], list[int]]], most: int = IDS) -> Iterator[pd.DataFrame]:
    """The frames encoded, in parts of about `most` ids (or one row): what a task holds follows neither the rows of a batch nor their lengths."""
    for pdf in frames:
        held, start, size = [], 0, 0
        for at, x in enumerate(zip(*(pdf[c] for c in columns)), 1):
            held.append(tuple(np.array(z, "i4") for z in make(*x)))
            size += len(held[-1][0])
            if size >= most or at == len(pdf):
                out = pdf.iloc[start:at].drop(columns=columns)
                for name, values in (("input_ids", [r[0] for r in held]), ("labels", [r[1] for r in held]), ("attention_mask", [np.ones(len(r[0]), "i4") for r in held])):
                    out[name] = pd.Series(values, index=out.index, dtype=object)
                yield out
                held, start, size = [], at, 0


def _encoded(df: DataFrame, columns: list[str], make: Callable[..., tuple[list[int], list[int]]]) -> DataFrame:
    """df with input_ids, labels and attention_mask in the place of `columns`; make gives ids and labels of their values."""

    kept = [f for f in df.schema.fields if f.name not in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "input_ids array<int>", "labels array<int>", "attention_mask array<int>"])
    return df.select(*(f.name for f in kept), *columns).mapInPandas(lambda frames: _in_parts(frames, columns, make), schema)


def encode_pairs(df: DataFrame, tokenize: Callable[[str], list[int]], prompt: str = "prompt", completion: str = "completion", most: int = 2048, end: str = "</s>") -> DataFrame:
    """Ids of prompt and completion as one text, cut at `most`; as many labels as the prompt alone has ids are masked."""

    def make(p: str, c: str) -> tuple[list[int], list[int]]:
        seam = "" if p.endswith((" ", "\n", "\t")) or c.startswith((" ", "\n", "\t")) else " "
        ids = tokenize(f"{p}{seam}{c}{end}")[:most]
        masked = min(len(ids), len(tokenize(p)[:most]))
        return ids, [MASK] * masked + ids[masked:]

    return _encoded(df, [prompt, completion], make)


class Pieces:
    """A tokenizer that cuts a text into the matches of a pattern and gives each one's ids, whatever stands around it.

    What a match takes may depend on what follows, up to one character behind the next match, and on nothing before it: then the ids of a text's beginning are
    those of the pieces before its last two, and only from there on have to be made again (see prefixes)."""

    def __init__(self, pattern: str, ids: Callable[[str], list[int]], memo: int = 1 << 16):
        self.pattern, self.ids, self.memo = pattern, ids, memo

    def __reduce__(self):
        return Pieces, (self.pattern, self.ids, self.memo)

    @cached_property
    def _cut(self):
        return regex.compile(self.pattern)

    @cached_property
    def _piece(self):
        return lru_cache(maxsize=self.memo)(lambda piece: tuple(self.ids(piece)))

    def __call__(self, text: str) -> list[int]:
        return [i for m in self._cut.finditer(text) for i in self._piece(m.group())]

    def prefixes(self, text: str, ends: list[int]) -> tuple[list[int], list[int]]:
        """The ids of text[:ends[-1]], and how many ids each text[:end] has, in one pass over the text and the pieces at the ends."""
        stops, before, whole = [0], [0], []
        for m in self._cut.finditer(text):
            whole.extend(self._piece(m.group()))
            stops.append(m.end())
            before.append(len(whole))
        tail: list[int] = []
        counts, k = [], 0
        for end in ends:
            k = max(0, bisect_left(stops, end, 1) - 2)  # the next piece ends inside too, with a character behind it
            tail = self(text[stops[k] : end])
            counts.append(before[k] + len(tail))
        return whole[: before[k]] + tail, counts


def encode(df: DataFrame, tokenize: Callable[[str], list[int]], messages: str = "messages", most: int = 2048, end: str = "</s>") -> DataFrame:
    """Ids of a conversation as one text, cut at `most`. What other roles say is masked, from the length of the ids of all before it to the
    length with it, and the mark of an assistant's turn that follows; no turns or an unknown role raise an error.

    With a tokenizer of Pieces a conversation is tokenised once; any other tokenises the text before each turn anew."""

    def lengths(text: str, whole: int, ends: list[int]) -> tuple[list[int], list[int]]:
        """The ids of text[:whole], and how many ids the text has up to each end."""
        if isinstance(tokenize, Pieces):
            ids, counts = tokenize.prefixes(text, [*ends, whole])
            return ids, counts[:-1]
        return tokenize(text[:whole]), [len(tokenize(text[:e])) for e in ends]

    def make(turns) -> tuple[list[int], list[int]]:
        if not len(turns):
            raise ValueError("a conversation without turns")
        if unknown := {t["role"] for t in turns} - MARKS.keys():
            raise ValueError(f"no mark for the role {unknown}")
        shown = [f"{MARKS[t['role']]}{t['content'].strip()}{end if t['role'] == 'assistant' else ''}\n" for t in turns]
        text, at, spans = "".join(shown), 0, []
        for i, (t, part) in enumerate(zip(turns, shown)):
            follows = len(MARKS["assistant"]) if i + 1 < len(turns) and turns[i + 1]["role"] == "assistant" else 0
            if t["role"] != "assistant":
                spans.append((at, at + len(part) + follows))
            at += len(part)
        ids, counts = lengths(text, len(text.rstrip()), [e for span in spans for e in span])
        ids = ids[:most]
        labels = list(ids)
        for start, stop in zip(counts[::2], counts[1::2]):
            start, stop = min(start, len(ids)), min(stop, len(ids))
            labels[start:stop] = [MASK] * (stop - start)
        return ids, labels

    return _encoded(df, [messages], make)


def has_target(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != MASK)


def first_true(flags: Column) -> Column:
    """Index of the first true, the length without one."""
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(F.size(flags))


def until_stop(ids: Column, stop: int, fill: int) -> Column:
    """ids with all after the first stop replaced."""
    at = F.array_position(ids, F.lit(stop))
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i >= at), F.lit(fill)).otherwise(x))
