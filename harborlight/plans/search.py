"""Lexical, vector and fused retrieval, roll-up, context packages and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approximate_tokens, tokens
from ..operators.relational import first_rows, first_wins, restrict, within_budget
from ..tables import table_state, write_shared

MODES = ("full_hybrid", "bm25_only", "vector_only", "hybrid_no_rerank")
#: Query vectors that one pass over the corpus compares; more go in further passes.
QUERY_BLOCK = 4_096


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The inverted index (term, key, tf) and the lengths (key, n_terms) of texts with terms."""
    words = docs.where(F.col(key).isNotNull()).select(key, tokens(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    index = words.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return index, words.select(key, F.size("terms").alias("n_terms"))


@dataclass(frozen=True)
class Index:
    """An inverted index as tables: (term, key, tf) in term order, (key, n_terms), (term, df), and one row of statistics."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    stats: DataFrame


_BUILT: dict[tuple, Index] = {}


def build_index(docs: DataFrame, key: str, text: str) -> Index:
    """The index of a table's texts, written to the shared folder once for each state of the table.

    Postings lie in term order within each file, so a reader of some terms skips the row groups of the others. Terms, keys
    and counts are all that is shuffled.
    """
    state = table_state(docs)
    if state and (state, key, text) in _BUILT:
        return _BUILT[(state, key, text)]
    index, lengths = postings(docs, key, text)
    lengths = write_shared(lengths, "lengths")
    index = write_shared(index.sortWithinPartitions("term"), "postings")
    frequencies = write_shared(index.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    out = Index(index, lengths, frequencies, lengths.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("avg_terms")))
    if state:
        _BUILT[(state, key, text)] = out
    return out


_VECTORS: dict[tuple, DataFrame] = {}


def build_vectors(docs: DataFrame, key: str, text: str, embedder: Callable[[Column], Column]) -> DataFrame:
    """(key, v): the embeddings of a table's texts, written to the shared folder once for each state of the table and
    embedder. Null keys and texts have none."""
    state = table_state(docs)
    known = (state, key, text, embedder)
    if state and known in _VECTORS:
        return _VECTORS[known]
    out = write_shared(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, embedder(F.col(text)).cast("array<float>").alias("v")), "vectors")
    if state:
        _VECTORS[known] = out
    return out


def bm25(index: Index, key: str, queries: DataFrame, query_key: str, query_text: str, size: int, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_key, key, score, rank): the ``size`` best documents of each query by BM25 over its distinct terms.

    Statistics cover all documents; the allowed keys restrict scoring, not the statistics. Terms of the queries reach the
    index by an equi-join before anything is scored. Ties go by key.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    terms = index.frequencies.join(asked.select("term").distinct(), "term", "left_semi")
    rows = restrict(index.postings.join(terms, "term"), allowed, key).join(index.lengths, key).join(F.broadcast(index.stats))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("avg_terms")))
    scored = rows.select("term", key, part.alias("part")).join(asked, "term").groupBy(query_key, key).agg(F.round(F.sum("part"), 6).alias("score"))
    return first_rows(scored, [query_key], [F.col("score").desc(), F.col(key)], size).select(query_key, key, "score", "rank")


def _best(block: np.ndarray, ids: list[int], size: int, own: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lists = batch.column(0).to_numpy(), batch.column(1)
            dim = block.shape[1]
            fits = np.array([x is not None and len(x) == dim for x in lists.to_pylist()]) if lists.null_count or len(lists.flatten()) != dim * len(lists) else None
            if fits is not None:
                keys, lists = keys[fits], lists.filter(pa.array(fits))
            if not len(keys):
                continue
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), dim).astype(np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            scores = np.round(block @ np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).T, 6)
            take = min(size + 1, len(keys))
            top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            edge = np.take_along_axis(scores, top, 1).min(1)
            for q, row, least in zip(ids, scores, edge):
                at = np.flatnonzero(row >= least)  # ties at the edge stay for the order by key
                old = best.get(q, [])
                old += [(-s, int(k)) for s, k in zip(row[at].tolist(), keys[at].tolist()) if not own or k != q]
                old.sort()
                best[q] = old[:size]
        rows = [(q, k, -s) for q, found in best.items() for s, k in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query", "key", "score"])

    return run


def vector_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, size: int, allowed: DataFrame | None = None, without_self: bool = False) -> DataFrame:
    """(query_key, key, score, rank): the ``size`` nearest vectors of each query by cosine, exactly.

    Queries go to the corpus in blocks of QUERY_BLOCK, each one matrix product a batch and at most ``size`` rows a query and
    task. Of several blocks, each runs and is written before the next is read, so the driver holds one, whatever their
    number. Null vectors and those of another length have no
    rows; the zero vector has score 0. Ties go by key.
    """
    corpus = restrict(vectors.where(F.col(key).isNotNull()), allowed, key).select(F.col(key).cast("long"), vector)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).orderBy("q").collect()
        if own:
            m = np.array([r.v for r in own], float)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            found = corpus.mapInArrow(_best(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), [r.q for r in own], size, without_self), "query long, key long, score double")
            parts.append(write_shared(found, "nearest") if blocks > 1 else found)
    if not parts:
        parts = [corpus.select(F.col(key).alias("query"), F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)]
    found = reduce(DataFrame.unionAll, parts).select(F.col("query").alias(query_key), F.col("key").alias(key), F.col("score"))
    return first_rows(found, [query_key], [F.col("score").desc(), F.col(key)], size).select(query_key, key, "score", "rank")


def fuse(lists: Sequence[DataFrame], query: str, key: str, k: int = 60, size: int | None = None) -> DataFrame:
    """(query, key, rrf, rank) by reciprocal rank fusion; ties go by the place in the first list, then in the next, then by key."""
    tagged = reduce(DataFrame.unionByName, (d.select(query, key, F.lit(i).alias("list"), "rank") for i, d in enumerate(lists)))
    places = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(lists))]
    fused = tagged.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), *places)
    order = [F.col("rrf").desc(), *(F.col(f"_r{i}").asc_nulls_last() for i in range(len(lists))), F.col(key)]
    return first_rows(fused, [query], order, size or 1 << 30).select(query, key, "rrf", "rank")


def lexical_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def hybrid(mode: str, lexical: DataFrame, vector: DataFrame, query: str, key: str, score: Callable[[DataFrame], DataFrame] | None = None, cut: int = 15) -> DataFrame:
    """(query, key, score, rank) in one of four modes; an unknown one is full_hybrid.

    The arms that a mode doesn't need aren't planned. The first ``cut`` candidates are scored by ``score`` (a plan that adds
    a column ``score``), or by their place in hybrid_no_rerank: n for the first of n.
    """
    mode = mode if mode in MODES else MODES[0]
    if mode == "bm25_only":
        found = first_rows(lexical.drop("rank"), [query], [F.col("score").desc(), F.col(key)], cut)
    elif mode == "vector_only":
        found = first_rows(vector.drop("rank"), [query], [F.col("score").desc(), F.col(key)], cut)
    else:
        found = fuse([lexical, vector], query, key, size=cut)
    found = found.select(query, key, F.col("rank").alias("first_rank"))
    if mode == "hybrid_no_rerank" or score is None:
        scored = found.withColumn("score", (F.count("*").over(Window.partitionBy(query)) - F.col("first_rank") + 1).cast("double"))
    else:
        scored = score(found)
    return first_rows(scored, [query], [F.col("score").desc(), F.col("first_rank"), F.col(key)], cut).select(query, key, "score", "rank")


def roll_up(chunks: DataFrame, query: str, owner: str, chunk: str, size: int) -> DataFrame:
    """(query, owner, score, chunk, rank): owners by their best chunk's score; the earlier chunk on a tie."""
    best = first_wins(chunks.withColumn("_minus", -F.col("score")).select(query, owner, chunk, "score", "_minus"), [query, owner], ["_minus", chunk])
    return first_rows(best, [query], [F.col("score").desc(), F.col(owner)], size).select(query, owner, "score", chunk, "rank")


def context(chunks: DataFrame, group: str, key: str, text: str, score: str, budget: int, separator: str = "\n---\n") -> DataFrame:
    """(group, context_text, citations, n_chunks, used_tokens): the best chunks that fit the budget, the first in any case."""
    sized = chunks.withColumn("_tokens", approximate_tokens(F.col(text)))
    kept = within_budget(sized, [group], [F.col(score).desc(), F.col(key)], "_tokens", budget, least_cost=1)
    packed = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("key"), F.col(text).alias("text"), "_tokens"))).alias("c"))
    cite = F.transform("c", lambda c: F.concat(F.format_string("cit-%03d", c["rank"]), F.lit(":"), c["key"]))
    return packed.select(group, F.array_join(F.transform("c", lambda c: c["text"]), separator).alias("context_text"), F.array_join(cite, ",").alias("citations"), F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0), lambda s, c: s + c["_tokens"]).alias("used_tokens"))


def with_metadata(contexts: DataFrame, metadata: DataFrame, group: str, name: str, count: Callable[[Column], Column] = approximate_tokens) -> DataFrame:
    """Contexts beside the metadata of their group, with the tokens of both by ``count``; a group without a context has its
    metadata alone, no chunks and no context tokens."""
    out = metadata.join(contexts, group, "left")
    return out.select(*metadata.columns, "context_text", "citations", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("context_text").isNull(), F.lit(0)).otherwise(count(F.col("context_text"))).alias("context_tokens"), count(F.col(name)).alias("metadata_tokens"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, recall, hit, mrr, ndcg, zero_result) at k, for every query with relevant keys.

    ``relevant`` has the place (from 1) of each key in the ideal order; its gain is n - place + 1.
    """
    sizes = relevant.groupBy(query).agg(F.count("*").alias("n"))
    gains = relevant.join(sizes, query).select(query, key, (F.col("n") - F.col("place") + 1).alias("gain"), F.col("place"))
    discount = lambda c: F.log2(F.col(c) + 1)
    ideal = gains.where(F.col("place") <= k).groupBy(query).agg(F.sum(F.col("gain") / discount("place")).alias("idcg"))
    any_found = ranked.groupBy(query).agg(F.count("*").alias("found"))
    hits = ranked.where(F.col("rank") <= k).join(gains, [query, key]).groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("gain") / discount("rank")).alias("dcg"))
    out = sizes.join(ideal, query, "left").join(hits, query, "left").join(any_found, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(query, F.round(zero(F.col("hits") / F.col("n")), 6).alias("recall"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.round(zero(1 / F.col("first")), 6).alias("mrr"), F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.when(F.col("found") > 0, 0.0).otherwise(1.0).alias("zero_result"))


def mean_metrics(metrics: DataFrame, names: Sequence[str], group: Column) -> DataFrame:
    """Means per group and over all (group 'all'), nulls left out, 0 where every value is null."""
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names]
    keyed = metrics.withColumn("grp", group)
    return keyed.groupBy("grp").agg(*means).unionByName(keyed.agg(*means).withColumn("grp", F.lit("all")))
