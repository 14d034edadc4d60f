"""Text functions on columns. All but ``composed`` are built from JVM expressions; None stands for no text throughout."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _bare(c: str) -> str | None:
    """What is left of a composed letter without its marks; None if it has none."""
    parts = unicodedata.normalize("NFD", c)
    return parts[0] if len(parts) > 1 and all(unicodedata.category(m) == "Mn" for m in parts[1:]) else None


#: Letters with marks and the letters below them, of all scripts, by rule from the character database.
_MARKED = [(c, b) for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0x10000)]) if (b := _bare(c)) is not None]


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """The text in canonical composition (NFC)."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fold(text: Column, keep_d: bool = True) -> Column:
    """Lower case without marks; the letter đ is kept, or is d where ``keep_d`` is off."""
    low = F.lower(text)
    plain = F.regexp_replace(F.translate(low, "".join(c for c, _ in _MARKED), "".join(b for _, b in _MARKED)), r"\p{Mn}+", "")
    return plain if keep_d else F.translate(plain, "đ", "d")


def normalise(text: Column) -> Column:
    """Folded, underscores as spaces, runs of white space as one, trimmed."""
    return F.trim(F.regexp_replace(F.translate(fold(text), "_", " "), r"\s+", " "))


def tokens(text: Column, folded: bool = False) -> Column:
    """Runs of letters and digits, lower case; an empty array for no text."""
    return F.coalesce(F.regexp_extract_all(fold(text, False) if folded else F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def long_words(text: Column, least: int) -> Column:
    """Words of letters alone, lower case, of ``least`` letters or more; an empty array for no text."""
    return F.coalesce(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1)), lambda w: F.char_length(w) >= least), F.array().cast("array<string>"))


def segmented(text: Column, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """The text's words joined by spaces, by a word segmenter for languages that don't write them apart: a function of a
    column, such as a pandas UDF around a library. Without one the text stays as it is."""
    return segmenter(text) if segmenter else text


def sentences(text: Column, newlines: bool = False) -> Column:
    """Sentences with their end marks, trimmed, without empty ones; also cut at line ends where ``newlines`` is on."""
    pattern = r"(?<=[.!?])\s+|\n+" if newlines else r"(?<=[.!?…])\s+"
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: s != "")


def clean_space(text: Column) -> Column:
    """No byte-order mark, spaces and tabs collapsed, at most one blank line in a row, trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, r"\x{FEFF}", ""), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def join_non_empty(sep: str, *parts: Column) -> Column:
    """The parts that aren't null or blank, trimmed and joined."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")), sep)


def context_prefix(text: Column, *parts: Column) -> Column:
    """``A — B. text``, without the parts that are empty."""
    head = join_non_empty(" — ", *parts)
    return F.when(head == "", text).otherwise(F.concat(head, F.lit(". "), text))


def slug(text: Column) -> Column:
    """Upper-case letters and digits of the folded text joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(fold(text, False)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def repair(text: Column, wrong_to_right: dict[str, str]) -> Column:
    """Every wrong piece of text replaced by its right one, in the order given."""
    for wrong, right in wrong_to_right.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def split_qualifier(text: Column) -> Column:
    """(name, qualifier) of ``name (qualifier)`` or ``name / qualifier``; the qualifier is null where there is none."""
    bracket, slash = F.regexp_extract(text, r"^(.*?)\s*\(([^)]*)\)\s*$", 2), F.regexp_extract(text, r"^(.*?)\s*/\s*(.*)$", 2)
    name = F.when(bracket != "", F.regexp_extract(text, r"^(.*?)\s*\(([^)]*)\)\s*$", 1)).when(slash != "", F.regexp_extract(text, r"^(.*?)\s*/\s*(.*)$", 1)).otherwise(F.trim(text))
    return F.struct(F.trim(name).alias("name"), F.when(bracket != "", F.trim(bracket)).when(slash != "", F.trim(slash)).alias("qualifier"))


def variants(text: Column) -> Column:
    """The forms a name is looked up by: as it is, lower case, folded with and without đ; without repetitions."""
    return F.array_distinct(F.filter(F.array(F.trim(text), F.lower(F.trim(text)), F.trim(fold(text)), F.trim(fold(text, False))), lambda s: s != ""))


def snippet(text: Column, needle: Column, around: int) -> Column:
    """The needle's first place with up to ``around`` characters on both sides; null if it isn't there."""
    at = F.call_function("locate", needle, text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, F.char_length(needle) + around + at - start))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def ngrams(words: Column, longest: int) -> Column:
    """All n-grams of 1 to ``longest`` words joined by spaces, longest first; without repetitions."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(longest, 0, -1))))


def negated(text: Column, needle: Column, cues: list[str], window: int = 3) -> Column:
    """Whether one of the ``window`` words before the first place of ``needle`` is a cue of negation."""
    before = F.filter(F.split(F.call_function("left", text, F.call_function("locate", needle, text) - 1), r"\s+"), lambda w: w != "")
    last = F.when(F.size(before) > window, F.slice(before, F.size(before) - window + 1, window)).otherwise(before)
    return F.coalesce(F.arrays_overlap(last, F.array(*map(F.lit, cues))), F.lit(False))


def pattern_rules(text: Column, rules: dict[str, str]) -> Column:
    """The names of the rules whose pattern the text has, in the order of the rules."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in rules.items())), lambda r: r.isNotNull())


def number_after(text: Column, pattern: str, group: int = 1) -> Column:
    """The number in a group of the pattern's first place, with a comma or point for decimals; null if none."""
    return F.replace(F.regexp_extract(text, pattern, group), F.lit(","), F.lit(".")).try_cast("double")


def strip_comments(text: Column) -> Column:
    """JSON with comments, without them; strings that hold // keep it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r'(?m)^((?:[^"\n/]|"(?:[^"\\\n]|\\.)*"|/(?!/))*)//.*$', "$1")


def fenced(text: Column, language: str = "json") -> Column:
    """The content of the first fenced block of a language, else the text."""
    inner = F.regexp_extract(text, rf"(?s)```(?:{language})?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(text)


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, length)


def cache_key(*parts: Column) -> Column:
    """The first 32 digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def name_uuid(text: Column, namespace: str = str(uuid.NAMESPACE_DNS)) -> Column:
    """The version 5 UUID of a name: SHA-1 over namespace and name with its version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
