"""Text measures and clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode blanks as a word splitter sees them: \s under Unicode rules and the four separators U+001C to U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def words(text: Column) -> Column:
    return F.size(word_list(text))


def chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def tokens_of_words(n: Column) -> Column:
    """int(words * 1.33)."""
    return F.floor(n * 133 / 100).cast("long")


def tokens_mixed(text: Column) -> Column:
    """int(1.5 per Hangul syllable + 1 per English word + 0.5 per digit or non-word character)."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return F.floor(1.5 * count("[가-힣]") + count(r"(?U)\b[a-zA-Z]+\b") + 0.5 * count(r"(?U)[0-9]|\W")).cast("long")


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.3, price_out: float = 2.5) -> Column:
    """US dollars at prices per million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def drop_trailing(text: Column, marker: str = "대화 상태:") -> Column:
    """Cut a marker that ends the text, and the blanks around it."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    cut = F.regexp_replace(F.substring(bare, F.lit(1), F.length(bare) - len(marker)), r"(?U)\s+$", "")
    return F.when(bare.endswith(marker), cut).otherwise(text)


def tidy_translation(text: Column, ascii_only: bool = False) -> Column:
    """Each sentence once, no Latin runs of 20 letters or more, single blanks.

    A run ends at a word's bound: beside letters of any script, or, with `ascii_only`, beside A-Z, a-z, 0-9 and _ alone (a run after é goes then); blanks are those of ASCII then, but at the ends."""
    blank, start, end = (r"[ \t\n\f\r]", "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])") if ascii_only else (r"\s", r"\b", r"\b")
    once = F.array_distinct(F.filter(F.transform(F.split(text, r"\."), lambda s: F.regexp_replace(s, rf"(?U)^{blank}+|{blank}+\z", "")), lambda s: s != ""))
    joined = F.array_join(once, ". ")
    joined = F.when((joined != "") & ~joined.endswith("."), F.concat(joined, F.lit("."))).otherwise(joined)
    bare = F.regexp_replace(joined, rf"(?U){start}[A-Za-z]{{20,}}{end}", "")
    return F.regexp_replace(F.regexp_replace(bare, f"{blank}+", " "), r"^\p{Zs}+|\p{Zs}+\z", "") if ascii_only else squeeze(bare)


def translation_facts(source: Column, target: Column) -> dict[str, Column]:
    return {
        "source_length": chars(source), "target_length": chars(target), "length_ratio": chars(target) / F.greatest(chars(source), F.lit(1)),
        "has_hangul": F.coalesce(target.rlike("[가-힣]"), F.lit(False)), "has_latin": F.coalesce(target.rlike("[A-Za-z]{3,}"), F.lit(False)),
    }


def model_name(file_name: Column) -> Column:
    """results_<model>_3shot….json -> <model>."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(file_name, r"\.json$", ""), r"^results_", ""), r"_[0-9]+shot.*$", "")


def normal_answer(text: Column) -> Column:
    """Single blanks, then no punctuation, then lower case."""
    return F.lower(F.regexp_replace(squeeze(text), r"(?U)[^\w\s]", ""))


def numbered_sentences(text: Column) -> Column:
    """What follows 'Sentence 1:', 'Sentence 2:', …"""
    return F.transform(F.regexp_extract_all(text, F.lit(r"Sentence [0-9]+: (.+?)(?=Sentence [0-9]+:|$)")), lambda s: F.trim(s))


def shuffled(key: Column, seed: int = 42) -> Column:
    """Where a row comes in a seeded order: the first 60 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")
