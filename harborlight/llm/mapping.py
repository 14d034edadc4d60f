"""Problem 7: mapping freely typed values to a canonical list."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import table

NONE = "NONE"
# Words that qualify a value without changing what it stands for, folded, by facet.
QUALIFIERS = {
    "city": ("thanh pho", "tp", "trung tam", "city", "thi xa", "thi tran", "quan", "huyen", "khu vuc", "downtown", "center", "centre"),
    "amenity": ("co", "theo yeu cau", "phu phi", "available", "on request", "extra charge"),
}
#: Words before the name of a province; such a part of a value isn't the city.
PROVINCE = ("tinh", "province")
# Words before a place, folded.
AT = frozenset("o tai gan thuoc o gan near in at by from to a en de em di в".split())
#: Forms that are sent to the workers at once; a longer list goes in blocks of as many, one pass over the values a block.
MOST_FORMS = 200_000
_PARTS = re.compile(r"\s[-–—]\s|[,;/|()\[\]]")


def fold(text: str) -> str:
    """Case, accents, width and punctuation folded away; words joined by one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(re.findall(r"[^\W_]+", plain.replace("đ", "d").replace("ð", "d")))


def _marked(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).casefold()))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def token_set_similarity(a: str, b: str, most: int = 2) -> float:
    """The share of letters that two sets of words have in common, from 0 to 1, whatever their order: each word is set
    against its closest of the other set, ``most`` letters apart at most, and words left over count whole. Words run
    together are compared as they stand, too. Below 1 - most / letters the value is only a bound."""
    left, right, cost = sorted(set(a.split()), key=len, reverse=True), set(b.split()), 0
    for w in left:
        best = min(((edits(w, x, most), x) for x in sorted(right)), default=(most + 1, ""))
        if best[0] <= most and best[0] < max(len(w), len(best[1])):
            cost += best[0]
            right.remove(best[1])
        else:
            cost += len(w)
        if cost > most:
            break
    letters = max(len(a.replace(" ", "")), len(b.replace(" ", "")), 1)
    return max(0.0, 1 - min(cost + sum(map(len, right)), edits(a, b, most)) / letters)


class Mapper:
    """One facet's entries: an Aho-Corasick automaton over their folded forms, and token-set similarity for the rest."""

    def __init__(self, entries: Sequence[tuple[str, Sequence[str]]]):
        self.by_form: dict[str, set[str]] = {}
        self.marked: dict[str, list[str]] = {}
        for concept, forms in entries:
            for form in forms:
                if form and (k := fold(form)):
                    self.by_form.setdefault(k, set()).add(concept)
                    self.marked.setdefault(k, []).append(_marked(form))
        self.auto = ahocorasick.Automaton()
        for k in self.by_form:
            self.auto.add_word(f" {k} ", k)
        if self.by_form:
            self.auto.make_automaton()
        self.forms = list(self.by_form)
        self.bags = np.array([self._bag(k) for k in self.forms]) if self.forms else np.zeros((0, 37), int)

    @staticmethod
    def _bag(text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        slot = np.where((codes >= 97) & (codes <= 122), codes - 97, np.where((codes >= 48) & (codes <= 57), codes - 22, 36))
        return np.bincount(slot[codes != 32], minlength=37)

    def one(self, form: str) -> str | None:
        """The form's entry; '' if the form is shared by several and stands for none of them for sure, None if it is unknown."""
        found = self.by_form.get(form, ())
        return next(iter(found)) if len(found) == 1 else "" if found else None

    def hits(self, part: str) -> list[tuple[int, int, str]]:
        """(start, end, entry) of every form in a folded text, by its words' offsets; the automaton reads the text once."""
        return [(end - len(k) - 1, end - 1, self.one(k)) for end, k in self.auto.iter(f" {part} ")] if self.by_form else []

    def close(self, part: str, marked: str) -> list[tuple[float, int, str]]:
        """(distance, edits with accents, entry) of the forms that share all letters but one with a short text, or but two
        with one of nine or more; none for texts of less than three."""
        n = len(part.replace(" ", ""))
        most = 0 if n < 3 else 1 if n < 5 else 2
        if not most or not self.forms:
            return []
        diff = self.bags - self._bag(part)
        bag = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1))  # never above the number of edits
        out: list[tuple[float, int, str]] = []
        for i in np.flatnonzero(bag <= most):
            k = self.forms[i]
            letters = max(n, len(k.replace(" ", "")))
            if len(k) >= 4 and (concept := self.one(k)):
                far = round((1 - token_set_similarity(part, k, most)) * letters)
                if far <= min(most, 2 if len(k) > 8 else 1):
                    out.append((far, min(edits(marked, m, 6) for m in self.marked[k]), concept))
        return out


class Found:
    """What a block of the list found for one value; answers as a Mapper does."""

    def __init__(self, seen: dict):
        self.seen = seen

    def one(self, form: str) -> str | None:
        return self.seen["one"].get(form)

    def hits(self, part: str) -> list:
        return [tuple(h) for h in self.seen["hits"].get(part, ())]

    def close(self, part: str, marked: str) -> list:
        return [tuple(c) for c in self.seen["close"].get(part, ())]


def _strip(part: str, facet: str) -> str:
    words = sorted(QUALIFIERS.get(facet, ()), key=len, reverse=True)
    if not words:
        return part
    pattern = re.compile(rf"^(?:(?:{'|'.join(words)}) )+|(?: (?:{'|'.join(words)}))+$")
    return pattern.sub("", pattern.sub("", part))


def parts_of(value: str, facet: str) -> list[tuple[str, str, str]]:
    """(folded without qualifiers, with accents, as written) of a value's parts, without those named as a province."""
    out = []
    for raw in _PARTS.split(unicodedata.normalize("NFKC", value)):
        part = fold(raw)
        if part and part.split()[0] not in PROVINCE:
            out.append((_strip(part, facet), _marked(raw), raw))
    return out


def mentions(blocks: Sequence, part: str) -> list[tuple[int, int, str]]:
    """(start, end, entry) of the longest forms in a folded text that don't overlap, from left to right."""
    taken: list[tuple[int, int, str]] = []
    for h in sorted((h for b in blocks for h in b.hits(part)), key=lambda h: (h[0] - h[1], h[0])):
        if all(h[1] <= t[0] or h[0] >= t[1] for t in taken):
            taken.append(h)
    return sorted(taken)


def _stands_alone(part: str, raw: str, start: int, end: int) -> bool:
    """Whether the words beside a mention aren't part of a longer name: written small where names are written large, or,
    where all is written alike, a word that stands before places."""
    before, after = part[: max(start - 1, 0)].split(), part[end:].split()
    words = re.findall(r"[^\W_]+", raw)
    inner = len(part.split())
    at = next((i for i in range(len(words) - inner + 1) if fold(" ".join(words[i : i + inner])) == part), None)
    cased = at is not None and raw != raw.lower() and raw != raw.upper()
    if cased:
        left, right = words[at : at + len(before)], words[at + inner - len(after) : at + inner]
        return not (left and left[-1][0].isupper()) and not (right and right[0][0].isupper())
    return (not before or before[-1] in AT) and not after


def decide(blocks: Sequence, facet: str, value: str) -> str:
    """The entry a value stands for, or NONE: the value as a whole, else the longest mention in one of its parts, else the
    closest set of words. A city's name has to fill its part or to stand alone in it."""
    whole = fold(value)
    if (one := next((o for b in blocks if (o := b.one(whole)) is not None), None)) is not None and one:
        return one
    parts, city = parts_of(value, facet), facet == "city"
    found = [(part, raw, mentions(blocks, part)) for part, _, raw in parts]
    for part, _, hits in found:
        best = max(hits, key=lambda h: h[1] - h[0], default=None)
        if best and best[2] and (not city or (len(hits) == 1 and best[1] - best[0] == len(part))):
            return best[2]
    for part, raw, hits in found if city else ():
        if len(hits) == 1 and hits[0][2] and _stands_alone(part, raw, hits[0][0], hits[0][1]):
            return hits[0][2]
    for part, marked in [(p, m) for p, m, _ in (parts[:1] if city else parts)] + [(whole, _marked(value))]:
        best = sorted(c for b in blocks for c in b.close(part, marked))
        if best and not any(c[:2] == best[0][:2] and c[2] != best[0][2] for c in best[1:]):
            return best[0][2]
    return NONE


def _look(mapper: Mapper, facet: str, value: str) -> dict:
    """All that one block has to say of a value."""
    parts = [(p, m) for p, m, _ in parts_of(value, facet)]
    texts = dict([*parts, (fold(value), _marked(value))])
    return {"one": {t: o for t in texts if (o := mapper.one(t)) is not None}, "hits": {p: h for p, _ in parts if (h := mapper.hits(p))}, "close": {t: c for t, m in texts.items() if (c := mapper.close(t, m))}}


_VALUES = pa.schema([("id", pa.int64()), ("facet", pa.string()), ("field", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("seen", pa.list_(pa.string()))])


def _block(entries: dict[str, list[tuple[str, list[str]]]]):
    """Adds what one block of the list finds to every value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappers = {facet: Mapper(e) for facet, e in entries.items()}
        for batch in batches:
            seen = []
            for facet, value, so_far in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                new = _look(mappers[facet], facet, value) if facet in mappers else {}
                seen.append([*(so_far or ()), *([json.dumps(new)] if any(new.values()) else ())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seen, _VALUES.field(5).type)], schema=_VALUES)

    return run


def _run(entries: dict[str, list[tuple[str, list[str]]]] | None, schema: pa.Schema):
    """Decides every value, by the whole list at once or by what its blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappers = {facet: [Mapper(e)] for facet, e in (entries or {}).items()}

        @lru_cache(maxsize=200_000)
        def match(facet: str, value: str) -> str:
            return decide(mappers[facet], facet, value)

        for batch in batches:
            facets, values = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            if entries is not None:
                concepts = [match(f, v) for f, v in zip(facets, values)]
            else:
                concepts = [decide([Found(json.loads(x)) for x in seen or ()], f, v) for f, v, seen in zip(facets, values, batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(concepts, pa.string())], schema=schema)

    return run


def _entries(rows: Sequence) -> dict[str, list[tuple[str, list[str]]]]:
    out: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        out.setdefault(r.facet, {}).setdefault(r.concept_id, []).append(r.form)
    return {f: [*e.items()] for f, e in out.items()}


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t))


def map_values(values: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, field, pos, concept_id) for (id, facet, field, pos, value) and a list (concept_id, facet, label_vi, label_en,
    surface_forms).

    A value is folded and cut at separators; words that only qualify are taken off. The automaton's longest mention
    decides; a city's name must fill its part of the value or stand alone in it, and a part named as a province is passed
    over. What has no mention goes to token-set similarity, and what is still unmatched, or as close to two entries, is
    reported as NONE. Null and blank values, and values that are an entry's label_vi as it stands, give no row. The list
    is read by the driver in blocks of MOST_FORMS forms, all writings of a form in one; values never are, and need no
    shuffle: each block is one pass over them, and a last pass decides by what all blocks found.
    """
    forms = concepts.where(F.col("facet").isNotNull() & F.col("concept_id").isNotNull()).select("facet", "concept_id", F.explode(F.array_distinct(F.filter(F.concat(F.array("label_vi", "label_en"), F.coalesce("surface_forms", F.array().cast("array<string>"))), lambda x: x.isNotNull()))).alias("form"))
    n_blocks = -(-forms.count() // MOST_FORMS)
    facets = [r.facet for r in forms.select("facet").distinct().collect()]
    todo = values.where(F.col("facet").isin(facets) & F.col("value").rlike(r"(?U)\S")).select(F.col("id").cast("long"), "facet", "field", F.col("pos").cast("int"), "value")
    label = concepts.select("facet", F.col("label_vi").alias("value")).where("value is not null").distinct()
    schema = pa.schema([("id", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("concept_id", pa.string())])
    out = "id long, field string, pos int, concept_id string"
    if n_blocks <= 1:
        labels: dict[str, list[str]] = {}
        for r in label.collect():
            labels.setdefault(r.facet, []).append(r.value)
        for f, known in labels.items():
            todo = todo.where(~((F.col("facet") == f) & F.col("value").isin(known)))
        return todo.mapInArrow(_run(_entries(forms.collect()), schema), out)
    todo = todo.join(label, ["facet", "value"], "left_anti").select("id", "facet", "field", "pos", "value", F.array().cast("array<string>").alias("seen"))
    hashed = forms.withColumn("block", F.pmod(F.xxhash64(_folded(F.col("form"))), F.lit(2 * n_blocks)))
    for k in range(2 * n_blocks):
        todo = todo.mapInArrow(_block(_entries(hashed.where(F.col("block") == k).select("facet", "concept_id", "form").collect())), "id long, facet string, field string, pos int, value string, seen array<string>")
    return todo.mapInArrow(_run(None, schema), out)


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The entry of each hotel's city and amenities that isn't written as the list has it."""
    hotels = table(spark, sf_dir, "hotels").where("id is not null")
    city = hotels.select("id", F.lit("city").alias("facet"), F.lit("city").alias("field"), F.lit(0).alias("pos"), F.col("city").alias("value"))
    amenities = hotels.select("id", F.lit("amenity").alias("facet"), F.lit("amenities").alias("field"), F.posexplode("amenities").alias("pos", "value"))
    found = map_values(city.unionByName(amenities), table(spark, sf_dir, "concepts"))
    return found.select(F.col("id").alias("hotel_id"), "field", "pos", "concept_id").distinct()
