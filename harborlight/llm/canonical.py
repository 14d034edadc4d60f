"""Problem 5: one consistent form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut_lineage, table

# Letters of other scripts that look like a Latin one, each above its twin: Cyrillic, Greek, Latin, Armenian,
# Cherokee, Lisu, Roman numerals, signs.
LOOK_ALIKE = "АВЕКМНОРСТУХЅІЈҮԌѴаеорсухѕіјһԁԛԝӏѵүЁЇёї" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνρ" "ÐƉ" "ՕՏօհսո" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏙᏞᏟᏢᏦ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ" "‐‑․∶ʼ"
LATIN_TWIN = "ABEKMHOPCTYXSIJYGVaeopcyxsijhdqwlvyËÏëï" "ABEZHIKMNOPTYXocjvp" "ĐĐ" "OSohun" "DRTAJEWMHGZRWSVLCPK" "BPDTGKJCZFMNLSRVHWXYAEIOU" "IVXLCDMivxlcdm" "--.:’"
# Full-width signs outside the block that follows by rule.
WIDE, PLAIN = "￠￡￢￤￥￦", "¢£¬¦¥₩"
#: All white space beyond what ASCII has; it looks like one space.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
#: Characters that don't show although the collation gives them weights or leaves them in: fillers, variation selectors.
FILLERS = "\u034f\u115f\u1160\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FROM = LOOK_ALIKE + WIDE + _FULL + SPACES + FILLERS
_TO = LATIN_TWIN + PLAIN + "".join(chr(ord(c) - 0xFEE0) for c in _FULL) + " " * len(SPACES)
#: What doesn't show and the collation ignores: format and control characters but white space.
_HIDDEN = "".join(c for c in map(chr, [*range(0x10000), 0x110BD, 0x110CD, *range(0x13430, 0x13440), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080)]) if unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\x0b\x0c\r\x85")
_PICTURE = "\U0001f000-\U0001faff\u2600-\u27bf"

#: Ligatures and half-width kana, which stand for the characters they are made of.
_MADE_OF = {c: unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), *range(0xFF61, 0xFFDD)) if c != 0xFFA0}
def _signs(ranges: str) -> str:
    """The inside of a character class from ranges of code points in hexadecimal."""
    return "".join(f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (r.partition("-") for r in ranges.split()))


_MARKS = "".join(c for c in map(chr, [*range(0x20000), *range(0xE0100, 0xE01F0)]) if unicodedata.category(c)[0] == "M")
#: Texts whose letters are mapped apart from their marks: with combining marks, Greek or Cyrillic letters, Hangul parts,
#: ligatures, half-width kana, or letters that canonical composition takes apart.
_APART = re.compile(f"[{_MARKS}{_signs('370-52F 958-95F 9DC-9DF A33 A36 A59-A5E B5C B5D F43-F69 1100-11FF 1F00-1FFF 2ADC FB00-FB06 FB1D-FB4E FF61-FFDC 1D15E-1D1C0')}]")
#: Characters among which the collation takes only canonically equal ones for equal, besides those it ignores. Texts with any
#: other (digits and letters of other scripts, circled and mathematical signs, marks, joined pictures) get an exact check.
_SURE = _signs(
    "0-A9 AB-B3 B5-B9 BB-E5 E7-EF F1-126 128-17E 180-1BD 1BF-1F2 1F4-24F 386-482 48A-52F 1E00-1EFF 200B-2027 202A-202E 2030-205E 2060-206F 20A0-20C0 2126 212A 212B 2190-23FF 2500-2775 2794-27BF "
    "3001-3006 3008-3020 3041-3096 309D-30FF 3400-9FFF AC00-D7A3 F900-FAFF FEFF 1F300-1FAFF 20000-2A6DF 2F800-2FA1D E0001-E007F"
)
_UNSURE = re.compile(rf"[^{_SURE}]|[{_PICTURE}]\u200d")
#: Texts of these characters alone, the great part, need nothing but their white space mapped, and no check.
_PLAIN = r"[^\t-\r\x20-\x7E\x{C0}-\x{CF}\x{D1}-\x{E5}\x{E7}-\x{EF}\x{F1}-\x{126}\x{128}-\x{17E}\x{1A0}-\x{1B0}\x{1E00}-\x{1EFF}\x{2013}-\x{201F}\x{2026}]"

_TWINS = {**str.maketrans(_FROM[: len(_TO)], _TO), **dict.fromkeys(map(ord, FILLERS))}
_GAP = re.compile(f"[{re.escape(_HIDDEN)}]*[ \t\n\x0b\x0c\r][ \t\n\x0b\x0c\r{re.escape(_HIDDEN)}]*")
_AROUND = re.compile(f"^[ {re.escape(_HIDDEN)}]+|[ {re.escape(_HIDDEN)}]+$")
_INSIDE = re.compile(f"(?:(?!\u200d)[{re.escape(_HIDDEN)}]|(?<![{_PICTURE}])\u200d)+")


def map_text(text: str) -> str:
    """Every character replaced by the plainest one that looks like it, runs of white space as one space, none at the ends.
    Letters are mapped apart from their marks and composed again, as the collation doesn't reorder a mark behind a composed
    letter; hidden characters within words are left to the collation."""
    apart = _APART.search(text) is not None
    t = (unicodedata.normalize("NFD", text.translate(_MADE_OF)) if apart else text).translate(_TWINS)
    t = _AROUND.sub("", _GAP.sub(" ", t))
    return unicodedata.normalize("NFC", t) if apart else t


def final_form(mapped: str) -> str:
    """A mapped text composed, without hidden characters but the joiner of pictures."""
    return unicodedata.normalize("NFC", _INSIDE.sub("", mapped))


_FORMS = T.StructType([T.StructField("mapped", T.StringType()), T.StructField("form", T.StringType()), T.StructField("unsure", T.BooleanType())])


@F.pandas_udf(_FORMS)
def _forms(s: pd.Series) -> pd.DataFrame:
    mapped = [None if t is None else map_text(t) for t in s]
    return pd.DataFrame({"mapped": mapped, "form": [None if m is None else final_form(m) for m in mapped], "unsure": [m is not None and _UNSURE.search(m) is not None for m in mapped]})


def _values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, stored, mapped, form, unsure) of every value that isn't null or blank. Plain texts are mapped in the JVM,
    the others, each once, in Arrow batches."""
    some = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"s{i}") for i, f in enumerate(fields)))
    seen = some.select("*", *(_forms(F.when(F.col(f"s{i}").rlike(_PLAIN), F.col(f"s{i}"))).alias(f"x{i}") for i in range(len(fields))))
    plain = lambda i: F.trim(F.regexp_replace(F.col(f"s{i}"), r"\s{2,}|[\t-\r]", " "))
    done = seen.select("id", *(F.struct(F.lit(f).alias("field"), F.col(f"s{i}").alias("stored"), F.coalesce(F.col(f"x{i}.mapped"), plain(i)).alias("mapped"), F.col(f"x{i}.form").alias("form"), F.coalesce(F.col(f"x{i}.unsure"), F.lit(False)).alias("unsure")).alias(f"v{i}") for i, f in enumerate(fields)))
    return done.select("id", F.explode(F.array(*(f"v{i}" for i in range(len(fields))))).alias("v")).select("id", "v.*").where("mapped != ''")


def _collation_key(text: Column) -> Column:
    """The sort key under the collation UNICODE. Functions of SQL hash a collated string by its plain bytes; the key is the
    expression by which Spark itself joins collated strings."""
    jvm = SparkContext._active_spark_context._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(bridge.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(bridge.expression(F.collate(text, "UNICODE")._jc))))


_CLASS = ["field", "look", "exact"]


def _keys(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, look, exact, stored): the hash of the key under the Unicode collation, the exact check where it is needed
    (0 elsewhere), the hash of the stored text.

    UNICODE compares case, accents and punctuation, ignores what doesn't show, and takes canonically equal texts for equal;
    so the key alone gives the class of texts whose characters are all among ``_SURE``. It also takes digits of several
    scripts, variants of one sign and some sequences (a Thai vowel before or after its letter) for equal, which look
    different; texts with such characters are told apart by the hash of their final form.
    """
    exact = F.when(F.col("unsure"), F.xxhash64("form")).otherwise(F.lit(0)).alias("exact")
    return _values(df, key, fields).select("id", "field", F.xxhash64(_collation_key(F.col("mapped"))).alias("look"), exact, F.xxhash64("stored").alias("stored"))


def membership(keys: DataFrame) -> DataFrame:
    """(field, canonical_id, canonical_stored, id, stored): every value with the canonical member of its class, the one with
    the smallest id. Partial aggregation finds it, however large a class is."""
    first = keys.groupBy(*_CLASS).agg(F.min(F.struct("id", "stored")).alias("c"))
    return keys.join(first, _CLASS).select("field", F.col("c.id").alias("canonical_id"), F.col("c.stored").alias("canonical_stored"), "id", "stored")


def look_alike_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, id_a, id_b): keys, smaller first, whose values look the same but aren't equal as stored.

    Null and blank values have no pairs; a key that comes again with the same values counts once. Texts are shuffled
    nowhere: classes are found on hashes, and only classes with more than one stored spelling are joined back to their
    canonical member. Pairs are formed between spellings first, so copies of one spelling, however many, never meet.
    """
    keys = cut_lineage(_keys(df, key, fields))
    mixed = keys.groupBy(*_CLASS).agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select(*_CLASS)
    members = membership(keys.join(mixed, _CLASS, "left_semi")).distinct()
    cls = ["field", "canonical_id", "canonical_stored"]
    spellings = members.select(*cls, "stored").distinct()
    two = spellings.withColumnRenamed("stored", "a").join(spellings.withColumnRenamed("stored", "b"), cls).where("a < b")
    left = two.join(members.select(*cls, F.col("stored").alias("a"), F.col("id").alias("x")), [*cls, "a"])
    both = left.join(members.select(*cls, F.col("stored").alias("b"), F.col("id").alias("y")), [*cls, "b"])
    return both.where("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def canonical(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, canonical_id, canonical): each value in the form of its class's canonical member, joined back to it.

    The member is the one with the smallest id. Null and blank values give no rows; rows that repeat a key count once.
    """
    members = membership(cut_lineage(_keys(df, key, fields))).distinct()
    heads = members.select("field", "canonical_id", "canonical_stored").distinct()
    v = _values(df, key, fields)
    texts = v.select("field", F.col("id").alias("canonical_id"), F.xxhash64("stored").alias("canonical_stored"), F.coalesce("form", "mapped").alias("canonical"))
    forms = texts.join(heads, ["field", "canonical_id", "canonical_stored"], "left_semi").dropDuplicates(["field", "canonical_id", "canonical_stored"])
    return members.join(forms, ["field", "canonical_id", "canonical_stored"]).select("id", "field", "canonical_id", "canonical").dropDuplicates(["id", "field"])


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of hotels whose names or descriptions look the same in different characters."""
    return look_alike_pairs(table(spark, sf_dir, "hotels"), "id", ["name", "description"])


def p5_canonical(spark, sf_dir: str) -> DataFrame:
    """Every name and description in its canonical form."""
    return canonical(table(spark, sf_dir, "hotels"), "id", ["name", "description"])
