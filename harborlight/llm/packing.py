"""Problem 9: filling containers of fixed capacity with documents, with certified bounds and repacking."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut_lineage, table
from .bpe import TOKENIZERS, token_counts

#: Documents a bucket is to have; it bounds what one task holds. The number of buckets follows the number of documents.
BUCKET_ITEMS = 25_000
#: Containers beyond its bound that a bucket gives up, with this many of its least filled ones each, to be repacked.
GIVE_UP = 12


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item (given in decreasing order) and the number of bins. Open bins are kept by free space."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1  # the least free space that holds it
            k = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, k = capacity, bins
            bins += 1
        out[i] = k
        rest = room - s
        if rest:
            free[rest].append(k)
            mask |= 1 << rest
    return out, bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions.

    f(x) maps sizes so that every set that fits sums to at most 1; the sum over all items is then a bound.
    """
    values, counts = np.unique(sizes, return_counts=True)
    best = -(-int((values * counts).sum()) // capacity) if len(values) else 0
    for k in range(1, 33):  # u(k): x if (k+1)x is whole, else floor((k+1)x)/k
        scaled = (k + 1) * values
        whole = scaled % capacity == 0
        total = Fraction(int((values * counts)[whole].sum()), capacity) + Fraction(int(((scaled // capacity) * counts)[~whole].sum()), k)
        best = max(best, -(-total.numerator // total.denominator))
    for least in values[values <= capacity // 2].tolist()[:: max(1, len(values) // 256)]:  # small items dropped, large ones whole
        large, middle = values > capacity - least, (values >= least) & (values <= capacity - least)
        total = int(counts[large].sum()) * capacity + int((values * counts)[middle].sum())
        best = max(best, -(-total // capacity))
    return best


def _pack(capacity: int, round_no: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        bins, used = best_fit_decreasing(sizes, capacity)
        gap = used - lower_bound(sizes, capacity)
        again = np.zeros(used, bool)
        fill = np.bincount(bins, sizes, used)
        short = np.argsort(fill, kind="stable")
        if not last and gap:
            again[short[: gap * GIVE_UP]] = True
        if not last:  # the one bin that every bucket leaves half empty
            again[short[:1]] |= fill[short[:1]] < 0.9 * capacity
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "part": pdf["part"].to_numpy(), "size": sizes, "container_id": (round_no << 58) + (int(key[0]) << 32) + bins, "again": again[bins]})

    return run


def pack(sizes: DataFrame, capacity: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, container_id) from (doc_id, n_tokens).

    Documents of 0 or null tokens need no container. One over ``capacity`` is split into full containers of its own and a
    rest, ``part`` counting from 0; every other document lies in one container whole. Documents are hashed to buckets of
    about ``bucket_items``, however they are distributed otherwise, and each bucket is packed by best-fit decreasing.
    Lower bounds from dual feasible functions certify a bucket whose number of containers can't be beaten; the others
    give up their least filled containers, whose documents meet in fewer buckets and are packed again, round by round,
    until one bucket is left. What is given up is a few containers a bucket, so no round is larger than a fraction of the
    one before. Ids are unique per document; a document id that comes again counts as another row and is packed too.
    """
    some = sizes.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
    some = cut_lineage(some)  # the token counts are dear; every round starts from what is written
    full = some.where(F.col("n_tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_tokens div {capacity} as int) - 1"))).alias("part"), F.lit(capacity).cast("long").alias("size"))
    rest = some.where(F.col("n_tokens") % capacity > 0).select("doc_id", F.expr(f"cast(n_tokens div {capacity} as int)").alias("part"), (F.col("n_tokens") % capacity).alias("size"))
    done, todo, n, round_no = [], rest, rest.count(), 0
    buckets = max(1, -(-n // bucket_items))
    while True:
        last = buckets == 1
        salt = F.pmod(F.xxhash64("doc_id", "part", F.lit(round_no)), F.lit(buckets))
        packed = todo.withColumn("bucket", salt).groupBy("bucket").applyInPandas(_pack(capacity, round_no, last), "doc_id long, part int, size long, container_id long, again boolean")
        if last:
            done.append(packed)
            break
        packed = cut_lineage(packed)
        done.append(packed.where("not again"))
        todo = packed.where("again").select("doc_id", "part", "size")
        left = todo.count()
        round_no += 1
        buckets = max(1, min(buckets // 4, -(-left // bucket_items)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # full containers of split documents have ids of their own: negative, by their place in what was written
    own = full.withColumn("container_id", -(F.monotonically_increasing_id() + 1))
    cols = ["doc_id", "part", (F.col("part") * F.lit(capacity)).cast("long").alias("start_token"), F.col("size").alias("n_tokens"), "container_id"]
    return out.select(*cols).unionByName(own.select(*cols))


def p9_containers(spark, sf_dir: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, capacity: int = 2048) -> DataFrame:
    """Every document of one token or more in containers of 2,048 tokens of byte_bpe_50k."""
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, folder), capacity)


def p9_quality(spark, sf_dir: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, capacity: int = 2048) -> DataFrame:
    """One row that tells whether the assignment is right and how good: containers, the least number that all tokens need,
    containers over the capacity, documents that are not assigned whole, and documents in pieces that would have fitted."""
    sizes = cut_lineage(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, folder))
    packed = cut_lineage(pack(sizes, capacity))
    fill = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("containers"), F.count_if(F.col("n") > capacity).alias("over_capacity"))
    got = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("parts"))
    both = sizes.where("n_tokens > 0").join(got, "doc_id", "full")
    docs = both.agg(F.ceil(F.sum("n_tokens") / capacity).alias("least_containers"), F.count_if(F.coalesce("got", F.lit(0)) != F.coalesce("n_tokens", F.lit(0))).alias("not_whole"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= capacity)).alias("split_in_vain"))
    return fill.join(F.broadcast(docs)).select("containers", "least_containers", "over_capacity", "not_whole", "split_in_vain")
