"""Tagging, fusion, dictionaries, profiles and concept search over texts and records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import fold, ngrams, tokens
from ..functions.values import wilson
from .relational import first_rows

#: Forms that are sent to the workers at once; more go in blocks, each a pass over the texts of its own.
MOST_FORMS = 100_000


def synonym_index(forms: DataFrame, form: str, concept: str, risky: int = 4) -> DataFrame:
    """(form, concept_ids): every form, lower case, and its folded variant, with the sorted concepts it names.

    A folded variant of one short word isn't indexed unless it is how the form is written: too many words fold to it.
    """
    low = F.lower(F.trim(form))
    plain = fold(low, False)
    long = forms.where(F.col(form).isNotNull()).select(F.col(concept).alias("c"), low.alias("a"), plain.alias("b"))
    risk = (F.col("a") != F.col("b")) & ~F.col("b").contains(" ") & (F.char_length("b") <= risky)
    each = long.select("c", F.explode(F.array_distinct(F.when(risk, F.array("a")).otherwise(F.array("a", "b")))).alias("form")).where("form <> ''")
    return each.groupBy("form").agg(F.array_sort(F.collect_set("c")).alias("concept_ids"))


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _find(rows: Sequence[tuple[str, str]], cues: Sequence[str], window: int, schema: pa.Schema):
    """One pass of an automaton over each text; a form's first place decides whether it is negated."""
    concepts: dict[str, list[str]] = {}
    for form, concept in rows:
        concepts.setdefault(form, []).append(concept)
    cue_set = frozenset(cues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ahocorasick.Automaton()
        for form in concepts:
            auto.add_word(form, form)
        auto.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first: dict[str, int] = {}
                for end, form in auto.iter(low):
                    if form not in first:
                        first[form] = end - len(form) + 1
                for form, at in first.items():
                    before = [w for w in _SPACE.split(low[:at]) if w][-window:] if cue_set else ()
                    out += [(key, c, form, not cue_set.isdisjoint(before)) for c in concepts[form]]
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def find_forms(docs: DataFrame, key: str, text: str, forms: DataFrame, form: str, concept: str, cues: Sequence[str] = (), window: int = 3) -> DataFrame:
    """(key, concept, form, negated) of every form of three characters or more that a lower-case text contains, anywhere in it.

    An automaton over the forms reads each text once, without a shuffle; more than MOST_FORMS forms go in blocks, with the
    same result. ``negated`` tells whether a cue stands within ``window`` words before the first place. Null texts and forms
    give nothing.
    """
    known = forms.where((F.char_length(form) >= 3) & F.col(concept).isNotNull()).select(F.lower(form).alias("form"), F.col(concept).cast("string").alias("concept")).distinct()
    low = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.lower(text).alias("low"))
    kind = low.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("concept", pa.string()), ("form", pa.string()), ("negated", pa.bool_())])
    ddl = f"`{key}` {kind.simpleString()}, concept string, form string, negated boolean"
    blocks = max(1, -(-known.count() // MOST_FORMS))
    parts = []
    for k in range(blocks):
        rows = [(r.form, r.concept) for r in known.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == k).collect()]
        if rows:
            parts.append(low.mapInArrow(_find(sorted(rows), cues, window, schema), ddl))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], ddl)


def fuse_tags(tags: DataFrame, key: str, bonus: float = 0.05) -> DataFrame:
    """(key, concept, confidence, nature, sources, evidence) from (key, concept, confidence, nature, source, evidence): the
    best confidence, a bonus for two sources or more (1 at most), presence before experience, and the first five distinct
    pieces of evidence."""
    agg = tags.groupBy(key, "concept").agg(F.bool_or(F.col("nature") == "presence").alias("there"), F.max("confidence").alias("best"), F.array_sort(F.collect_set("source")).alias("sources"), F.slice(F.array_sort(F.collect_set("evidence")), 1, 5).alias("evidence"))
    return agg.select(key, "concept", F.bround(F.least(F.lit(1.0), F.col("best") + F.when(F.size("sources") >= 2, bonus).otherwise(0.0)), 2).alias("confidence"), F.when(F.col("there"), "presence").otherwise("experience").alias("nature"), "sources", "evidence")


def expand_once(sets: DataFrame, key: str, concept: str, edges: DataFrame) -> DataFrame:
    """(key, concept) that one step along (src, dst) edges adds to each key's concepts."""
    added = sets.join(edges.select(F.col("src").alias(concept), "dst"), concept).select(key, F.col("dst").alias(concept)).distinct()
    return added.join(sets.select(key, concept), [key, concept], "left_anti")


def ngram_matches(df: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int = 4) -> DataFrame:
    """(key, form, concept_ids) of the n-grams of each folded text that the dictionary has."""
    grams = df.where(F.col(text).isNotNull()).select(key, F.explode(ngrams(tokens(F.col(text), True), longest)).alias("form"))
    return grams.join(dictionary, "form").select(key, "form", "concept_ids")


def profile(votes: DataFrame, group: str, voter: str, positive: Column, span: Column | None = None, order: str | None = None, least: int = 0) -> DataFrame:
    """(group, pos, neg, score[, span]): one vote per voter and group, scored by Wilson's lower bound, of the groups with
    ``least`` positive votes or more; the span is that of the first positive vote by ``order`` that has one."""
    first = [F.min(F.when(positive & span.isNotNull(), F.struct(F.col(order).alias("o"), span.alias("s")))).alias("first")] if span is not None else []
    once = votes.groupBy(group, voter).agg(F.bool_or(positive).alias("p"), *first)
    agg = once.groupBy(group).agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"), *([F.min("first").alias("first")] if first else [])).where(F.col("pos") >= least)
    return agg.select(group, "pos", "neg", F.round(wilson(F.col("pos"), F.col("pos") + F.col("neg")), 6).alias("score"), *([F.col("first.s").alias("span")] if first else []))


def merge_seed(seed: DataFrame, mentions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores from grades and from mentions in one row per key: grades win, mentions only add their counts; of several
    mentions of a key the last by position counts."""
    last = mentions.groupBy(*keys).agg(F.max_by(F.struct("pos", "neg", "score"), "position").alias("m"))
    return seed.join(last, list(keys), "full").select(*keys, F.coalesce("grade", F.col("m.score")).alias("score"), F.when(F.col("grade").isNotNull(), "grade").otherwise("mention").alias("source"), F.coalesce(F.col("m.pos"), F.lit(0)).alias("pos"), F.coalesce(F.col("m.neg"), F.lit(0)).alias("neg"))


def validate(rows: DataFrame, known: DataFrame, key: str, concept: str, confidence: str, sources: str) -> DataFrame:
    """(key, concept, problem) of rows that break the contract: unknown concept, confidence not within 0..1, no source."""
    ids = known.select(F.col("concept_id").alias(concept), F.lit(True).alias("_known"))
    problems = F.array(F.when(F.col("_known").isNull(), "unknown concept"), F.when(~F.coalesce(F.col(confidence).between(0, 1), F.lit(False)), "confidence"), F.when(F.coalesce(F.size(sources), F.lit(0)) < 1, "no source"))
    return rows.join(ids, concept, "left").select(key, concept, F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def merge_edges(known: DataFrame, mined: DataFrame) -> DataFrame:
    """(src, dst, source, lift): the ontology's edges, without loops, then the mined ones that it hasn't."""
    own = known.where("src <> dst").select("src", "dst").distinct()
    more = mined.join(own, ["src", "dst"], "left_anti").select("src", "dst", F.lit("cooccurrence").alias("source"), "lift")
    return own.select("src", "dst", F.lit("relation").alias("source"), F.lit(None).cast("double").alias("lift")).unionByName(more)


def audit_rules(rules: DataFrame, given: DataFrame, wanted: DataFrame, key: str, concept: str) -> DataFrame:
    """(src, dst, triggers, hits, noise) of expansion rules: the keys that have src, and of these those that want dst."""
    fired = rules.join(given.select(key, F.col(concept).alias("src")).distinct(), "src")
    met = fired.join(wanted.select(key, F.col(concept).alias("dst")).distinct().withColumn("met", F.lit(True)), [key, "dst"], "left")
    return met.groupBy("src", "dst").agg(F.count("*").alias("triggers"), F.count("met").alias("hits"), (F.count("*") - F.count("met")).alias("noise"))


def request_class(intent: Column, expected: Column, parsed: Column, wanted: Column, missing: Column, routed: Sequence[str]) -> Column:
    """What became of a request, for people to look at: router_needed for intents with one of the ``routed`` prefixes, unless
    only aspects are expected (out_of_scope), parser_miss if an expected or expanded concept is missing, expansion_risk if
    concepts came that nothing wants, else ok."""
    aspects = (F.size(expected) > 0) & F.forall(expected, lambda c: c.startswith("ASPECT_"))
    route = reduce(Column.__or__, (F.coalesce(intent.startswith(p), F.lit(False)) for p in routed), F.lit(False))
    lost = (F.size(F.array_except(expected, parsed)) > 0) | (F.size(missing) > 0)
    extra = (F.size(wanted) == 0) & (F.size(F.array_except(parsed, expected)) > 0)
    return F.when(aspects, "out_of_scope").when(route, "router_needed").when(lost, "parser_miss").when(extra, "expansion_risk").otherwise("ok")


@dataclass(frozen=True)
class Wanted:
    """What a concept search asks for: concepts to have, to prefer and to feel, kinds of objects, concepts that are evidence of
    a purpose, a folded piece of the place's name, least stars and score, and a price to be near."""

    hard: Sequence[str] = ()
    soft: Sequence[str] = ()
    feel: Sequence[str] = ()
    kinds: Sequence[str] = ()
    evidence: Sequence[str] = ()
    place: str | None = None
    star: float | None = None
    score: float | None = None
    price: float | None = None


def object_search(objects: DataFrame, key: str, wanted: Wanted, least: float = 0.6, size: int = 15) -> DataFrame:
    """(key, n_soft, n_purpose, feel, price_gap, rating, rank) of the ``size`` best objects (key, concepts, scores, kind,
    where, star, review_score, price) that have all hard concepts, a score of ``least`` for every feel concept and what else
    is asked for. Hard and feel concepts that no object satisfies are no condition; one aggregation tells which.

    Ranked by preferred concepts, evidence of the purpose, sum of feel scores, distance from the price (last where either is
    unknown or 0), rating and key.
    """
    score = lambda c: F.coalesce(F.try_element_at("scores", F.lit(c)), F.lit(0.0))
    among = lambda cs: F.size(F.array_intersect("concepts", F.array(*map(F.lit, cs)))) if cs else F.lit(0)
    terms = [F.array_contains("concepts", c) for c in wanted.hard] + [score(c) >= least for c in wanted.feel]
    alive = objects.agg(*(F.bool_or(t).alias(f"t{i}") for i, t in enumerate(terms))).first() if terms else ()
    found = objects
    for t, on in zip(terms, alive):
        found = found.where(t) if on else found
    if wanted.kinds:
        found = found.where(F.col("kind").isin(list(wanted.kinds)))
    if wanted.place:
        found = found.where(fold(F.col("where"), False).contains(wanted.place))
    for c, x in (("star", wanted.star), ("review_score", wanted.score)):
        found = found.where(F.col(c) >= x) if x is not None else found
    gap = F.when(F.col("price") > 0, F.abs(F.col("price") - wanted.price)).otherwise(F.lit(1e12)) if wanted.price else F.lit(1e12)
    feel = F.round(sum((score(c) for c in wanted.feel), F.lit(0.0)), 6)
    ranked = found.select(key, among(wanted.soft).alias("n_soft"), among(wanted.evidence).alias("n_purpose"), feel.alias("feel"), gap.alias("price_gap"), F.col("review_score").cast("double").alias("rating"), F.lit(1).alias("_q"))
    order = [F.col("n_soft").desc(), F.col("n_purpose").desc(), F.col("feel").desc(), F.col("price_gap"), F.col("rating").desc_nulls_last(), F.col(key)]
    return first_rows(ranked.orderBy(*order).limit(size), ["_q"], order, size).drop("_q")


def annotate(rows: DataFrame, call: Callable[[list[dict]], list[str | None]], tries: int = 3, batch: int = 32) -> DataFrame:
    """The rows with a column ``answer`` of what ``call`` says to each batch of them, such as a model. A call that raises is
    tried again; after ``tries`` the answers are null and ``failed`` is true, so a later run can take up those rows. A
    PermissionError is not tried again: it ends the job."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, answer string, failed boolean"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            answers: list[str | None] = []
            failed: list[bool] = []
            asked = frame.to_pylist()
            for k in range(0, len(asked), batch):
                part, said = asked[k : k + batch], None
                for _ in range(tries):
                    try:
                        said = list(call(part))
                        break
                    except PermissionError:
                        raise
                    except Exception:  # noqa: BLE001
                        continue
                answers += said if said is not None else [None] * len(part)
                failed += [said is None] * len(part)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(answers, pa.string()), pa.array(failed, pa.bool_())], names=[*frame.schema.names, "answer", "failed"])

    return rows.mapInArrow(run, schema)


def pick_forms(words: Sequence[str], found: Iterable[tuple[str, int]]) -> list[str]:
    """The forms that a text is read as, of those found at a place: the most words first, then the most characters; each takes
    its first free place, and a word that a form has taken is used up."""
    places: dict[str, list[int]] = {}
    for form, at in found:
        places.setdefault(form, []).append(at)
    free, out = [True] * len(words), []
    for form in sorted(places, key=lambda f: (-f.count(" "), -len(f), f)):
        n = form.count(" ") + 1
        for at in sorted(places[form]):
            if all(free[at : at + n]):
                free[at : at + n] = [False] * n
                out.append(form)
                break
    return out


def _greedy(forms: dict[str, list[str]] | None, longest: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, words, *given in zip(*columns):
                if forms is not None:
                    here = forms
                    found = [(g, i) for n in range(1, min(longest, len(words)) + 1) for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) in forms]
                else:
                    here = {x["form"]: x["concepts"] for x in given[0]}
                    found = [(x["form"], x["at"]) for x in given[0]]
                out += [(key, c, form) for form in pick_forms(words, found) for c in here[form]]
            rows = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


def greedy_concepts(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, concept, form): the forms with the most words first, then with the most characters; a word that a form has used
    can't be used again, and each form takes one place and gives all concepts it names.

    The fold over used words depends on its order, so it runs in Arrow batches, beside the dictionary where it has
    MOST_FORMS forms or fewer; a larger one is joined on the n-grams of the texts, with the same result.
    """
    known = dictionary.where(F.col("form").isNotNull() & (F.size("concept_ids") > 0)).select("form", "concept_ids")
    n, longest = known.agg(F.count("*"), F.max(F.size(F.split("form", " ")))).first()
    schema = pa.schema([("key", pa.int64()), ("concept", pa.string()), ("form", pa.string())])
    words = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), tokens(F.col(text), True).alias("words"))
    if n <= MOST_FORMS:
        out = words.mapInArrow(_greedy({r.form: sorted(r.concept_ids) for r in known.collect()}, longest or 0, schema), "key long, concept string, form string")
    else:
        def grams(k: int) -> Column:
            at = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.struct(F.array_join(F.slice("words", i + 1, F.lit(k)), " ").alias("form"), i.alias("at")))
            return F.when(F.size("words") >= k, at).otherwise(F.array().cast("array<struct<form:string,at:int>>"))

        rows = words.withColumn("row", F.xxhash64("words"))
        met = rows.select("key", "row", F.explode(F.concat(*map(grams, range(1, longest + 1)))).alias("g")).select("key", "row", "g.*").distinct().join(known, "form")
        lists = met.groupBy("key", "row").agg(F.collect_list(F.struct("form", "at", F.array_sort("concept_ids").alias("concepts"))).alias("given"))
        out = rows.join(lists, ["key", "row"]).select("key", "words", "given").mapInArrow(_greedy(None, 0, schema), "key long, concept string, form string")
    return out.withColumnRenamed("key", key)
