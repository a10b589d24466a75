"""Answers in model outputs: letters, numbers, labels and structured lines, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound

#: The number and unit patterns that answers are read with, the order of the cascade, and the words that
#: disqualify an isolated letter near them.
NUMBER = r"([+-]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?)"
UNITS = "달러|원|개|명|미터|센티미터|킬로미터|시간|일|dollars?|won|pieces?|meters?|hours?|days?"
NUMBER_CASCADE = [
    r"\{" + NUMBER + r"\}",
    r"####\s*" + NUMBER,
    "답[:：]\\s*" + NUMBER,
    r"The answer is\s*" + NUMBER,
    "(?:정답|Answer)[:：]\\s*" + NUMBER,
    r"(?:답|정답|Answer)\s*(?:은|는|is)?\s*" + NUMBER,
    "(?:따라서|그러므로|그래서|결론적으로|최종적으로|Hence|Therefore)\\s*(?:답|정답|answer)?[:：]?\\s*" + NUMBER,
    NUMBER + r"\s*(?:" + UNITS + r")(?:\s*(?:입니다|이다|\.|\s*$))",
    "(?:총|합계|전체|Total)\\s*[:：]?\\s*" + NUMBER,
    r"=\s*" + NUMBER + r"(?:\s*(?:" + UNITS + r"))?(?:\s*$)",
]
LETTER_CASCADE = [r"^\s*([ABCD])[.)\]\s]", r"^\s*\(?([ABCD])\)?\s*$", r"답\s*:?\s*([ABCD])", r"정답\s*:?\s*([ABCD])", r"^\s*([ABCD])\s*$"]
STOP_CONTEXTS = [
    "BECAUSE", "BECAU", "LOGICAL", "LOGIC", "ABSTRACT", "ABOUT", "ABOVE", "ACCORDING", "CONTEXT", "CONTENT", "CONSIDER", "CORRECT", "CONCEPT", "CALCULATE", "CHOICE", "CHART",
    "BETWEEN", "BEFORE", "BASIC", "BASED", "DISCUSS", "DESCRIBE", "DIFFERENT", "DETERMINE", "DECIDE", "DATA", "FOLLOWS", "FOLLOW", "LOGICALLY", "가나다라", "나다라마", "다라마바", "라마바사",
]
TOPICS = ["IT과학", "경제", "사회", "생활문화", "세계", "스포츠", "정치"]
RELATIONS = {"entailment": "함의", "contradiction": "모순", "neutral": "중립"}


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern)), F.lit(-1))


def boxed(output: Column, letters: str = "A-D", last: bool = False, upper: bool = True) -> Column:
    """The first (or last) {X} of a class of letters."""
    text, pattern = (F.upper(output) if upper else output), r"\{([" + letters + r"])\}"
    return _last(text, pattern) if last else _first(text, pattern)


def boxed_cut(output: Column) -> Column:
    """{A}-{J} before a new question begins."""
    return boxed(F.substring_index(F.substring_index(output, "Question:", 1), "질문:", 1), "A-J")


def letter_index(letter: Column) -> Column:
    return F.ascii(letter) - 65


def bracketed(output: Column) -> Column:
    """The first {letter}, its case kept; '' without one."""
    return F.coalesce(F.regexp_extract(output, r"\{([A-Za-z])\}", 1), F.lit(""))


def letter_cascade(output: Column) -> Column:
    """A leading letter, else marked letters in order, else an isolated letter that stands near no disqualifying word."""
    text = F.upper(F.regexp_replace(output, r"(?U)^\s+|\s+$", ""))
    lead = F.when(F.substring(text, 1, 1).isin("A", "B", "C", "D"), F.substring(text, 1, 1))
    marked = [_first(text, "(?U)" + p) for p in LETTER_CASCADE]
    # isolated letters with their surroundings: all of one letter's places are tried before the next found letter
    parts = F.split(text, r"(?U)(?<=\b[ABCD]\b)")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), "")))
    places = F.when(F.size(parts) > 1, F.transform(ends, lambda e: F.struct(F.substring(text, e, F.lit(1)).alias("letter"), F.substring(text, F.greatest(e - 20, F.lit(1)), F.least(e - 1, F.lit(20)) + 21).alias("near")))).otherwise(F.array().cast("array<struct<letter:string,near:string>>"))
    fine = F.filter(places, lambda p: ~F.exists(F.array(*map(F.lit, STOP_CONTEXTS)), lambda w: F.contains(p["near"], w)))
    order = F.filter(F.array_distinct(F.transform(places, lambda p: p["letter"])), lambda x: F.exists(fine, lambda p: p["letter"] == x))
    return F.coalesce(lead, *marked, F.try_element_at(order, F.lit(1)))


def number(output: Column, last: bool = False) -> Column:
    """The number of the first pattern of the cascade that matches, else the last number of the last line that has one."""
    text = F.regexp_replace(output, r"(?U)^\s+|\s+$", "")
    pick = _last if last else _first
    found = [F.replace(pick(text, "(?imU)" + p), F.lit(","), F.lit("")).try_cast("double") for p in NUMBER_CASCADE]
    per_line = F.transform(F.split(text, "\n"), lambda line: F.try_element_at(F.regexp_extract_all(line, F.lit("(?U)" + NUMBER)), F.lit(-1)))
    fallback = F.replace(F.try_element_at(F.filter(per_line, lambda x: x.isNotNull()), F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(*found, fallback)


def same_number(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    near = F.abs(a.cast("string").try_cast("double") - b.cast("string").try_cast("double")) < tolerance
    return F.coalesce(near, F.lit(False))


def same_integer(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("string").try_cast("long") == b.cast("string").try_cast("long"), F.lit(False))


def truth_letter(answer: Column, letters: str = "ABCD") -> Column:
    """Upper case, null outside the letters."""
    a = F.upper(F.trim(answer))
    return F.when(a.isin(*letters), a)


def truth_of_ten(answer: Column, index: Column) -> Column:
    return F.coalesce(truth_letter(answer, "ABCDEFGHIJ"), F.char(index + 65))


def truth_ending(label: Column) -> Column:
    """'' counts as -1."""
    return F.when(F.trim(label.cast("string")) == "", F.lit(-1)).otherwise(label.cast("string").try_cast("int"))


def truth_pair(label: Column) -> Column:
    return F.when(label == 0, "A").when(label == 1, "B")


def _line(text: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n", 1))


def topic(text: Column) -> Column:
    return reduce(lambda otherwise, t: F.when(F.contains(text, F.lit(t)), t).otherwise(otherwise), reversed(TOPICS), _line(text))


def similarity_score(text: Column) -> Column:
    found = _first(text, r"(\d+\.?\d*)").try_cast("double")
    return F.when(found.isNull(), 2.5).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(0.0), found)))


def relation(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda otherwise, kv: F.when(F.contains(low, F.lit(kv[0])) | F.contains(low, F.lit(kv[1])), kv[0]).otherwise(otherwise), reversed(list(RELATIONS.items())), _line(text))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def _groups(line: Column, pattern: str, groups: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """The groups of the first match, of which the first isn't empty; null without one."""
    got = [F.regexp_extract(line, "(?U)" + pattern, g) for g in groups]
    return bound(got[0], lambda x: F.when(x != "", F.struct(*(F.trim(g).alias(n) for g, n in zip((x, *got[1:]), names)))))


def dependencies(text: Column) -> Column:
    """array<struct(word, head, label)> of the lines that read as word -> head (label), word : head (label) or index word head label."""
    names = ("word", "head", "label")
    one = lambda s: F.coalesce(_groups(s, r"(\w+)\s*->\s*(\w+)\s*\((.+?)\)", (1, 2, 3), names), _groups(s, r"(\w+)\s*:\s*(\w+)\s*\((.+?)\)", (1, 2, 3), names), _groups(s, r"(\d+)\s+(\w+)\s+(\d+)\s+(.+)", (2, 3, 4), names))
    return F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull())


def entities(text: Column) -> Column:
    """array<struct(entity, kind)> of the lines entity: kind, entity (kind) or entity - kind."""
    names = ("entity", "kind")
    one = lambda s: F.coalesce(*(_groups(s, p, (1, 2), names) for p in (r"(.+?)\s*:\s*(.+)", r"(.+?)\s*\((.+?)\)", r"(.+?)\s*-\s*(.+)")))
    return F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull())


def dialogue_intent(text: Column) -> Column:
    """The last line's intent that names one."""
    one = lambda s: F.coalesce(*(_first(s, "(?iU)" + k + r"\s*:\s*(.+)") for k in ("의도", "intent", "목적")))
    return F.trim(F.try_element_at(F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull()), F.lit(-1)))


def dialogue_slots(text: Column) -> Column:
    """map of key: value or key = value lines but for intents; the last of a key counts."""
    names = ("key", "value")
    ok = lambda g: bound(g, lambda x: F.when(~F.lower(x["key"]).isin("의도", "intent", "목적"), x))
    one = lambda s: F.coalesce(ok(_groups(s, r"(.+?)\s*:\s*(.+)", (1, 2), names)), ok(_groups(s, r"(.+?)\s*=\s*(.+)", (1, 2), names)))
    found = F.reverse(F.filter(F.transform(_lines(text), one), lambda x: x.isNotNull()))
    latest = lambda f, keys: F.transform(keys, lambda k: F.try_element_at(F.filter(f, lambda x: x["key"] == k), F.lit(1))["value"])
    return bound(found, lambda f: bound(F.array_distinct(F.transform(f, lambda x: x["key"])), lambda keys: F.map_from_arrays(keys, latest(f, keys))))


def filtered(text: Column, pattern: str, group: int = 1, last: bool = False) -> Column:
    """A configured regular expression, its first (or last) match."""
    return _last(text, pattern) if last else _first(text, pattern, group)
