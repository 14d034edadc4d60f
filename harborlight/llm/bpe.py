"""Problem 8: encoding of a whole corpus with a public byte-level BPE by merge replay."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table

#: Where the public rank files lie; HARBORLIGHT_TOKENIZERS or an argument names another folder.
TOKENIZERS = os.environ.get("HARBORLIGHT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words are replayed in blocks of about this many bytes; a worker forgets its words beyond KEPT. Neither alters a result.
BLOCK_BYTES, KEPT = 1_000_000, 300_000


class MergeReplay:
    """Encodes a block of distinct words at once.

    All words lie in one array of symbols, linked to their neighbours. An inverted index leads from the rank of every
    mergeable pair to its positions. Ranks are taken in order; a merge visits its positions only, and only the pairs with
    the two touched neighbours enter the index anew. A merged pair's rank is always above its own, as the vocabulary was
    built in that order, so one pass over the ranks is exact.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair = self._pairs()
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        self.keys = np.sort(keys)
        self.ids = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        self.parts = {r: (k >> 20, k & 0xFFFFF) for k, r in self.pair.items()}

    def _pairs(self) -> dict[int, int]:
        """(left << 20 | right) -> the id the two become: each token's parts are what its bytes are just before its rank."""
        out = {}
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._below(token, rank)
                if len(parts) == 2:
                    out[parts[0] << 20 | parts[1]] = rank
        return out

    def _below(self, token: bytes, rank: int) -> list[int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.rank.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word, in the order given."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not lengths.sum():
            return [[] for _ in words]
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(flat), np.cumsum(lengths)
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        key = (flat[:-1] << 20) | flat[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == key) & ~last[:-1])
        ranks = self.ids[at[hit]]
        order = np.argsort(ranks, kind="stable")
        hit, ranks = hit[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        index = dict(zip(ranks[np.concatenate([[0], cut])].tolist(), (x.tolist() for x in np.split(hit, cut)))) if len(hit) else {}
        heap = sorted(index)

        sym = flat.tolist()
        nxt = np.where(last, -1, np.arange(1, n + 1)).tolist()
        prv = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1)).tolist()
        pair = self.pair
        while heap:
            r = heapq.heappop(heap)
            a, b = self.parts[r]
            for p in sorted(index.pop(r)):
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = r, -1
                after = nxt[p] = nxt[q]
                if after >= 0:
                    prv[after] = p
                    self._add(pair.get(r << 20 | sym[after]), p, index, heap)
                before = prv[p]
                if before >= 0:
                    self._add(pair.get(sym[before] << 20 | r), before, index, heap)
        sym_a = np.array(sym)
        alive = sym_a >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        ids, starts = sym_a[alive].tolist(), kept[np.concatenate([[0], ends])].tolist()
        return [ids[a:b] for a, b in zip(starts, starts[1:])]

    @staticmethod
    def _add(rank: int | None, position: int, index: dict[int, list[int]], heap: list[int]) -> None:
        if rank is not None:
            if rank in index:
                index[rank].append(position)
            else:
                index[rank] = [position]
                heapq.heappush(heap, rank)


@lru_cache(maxsize=2)
def replay(path: str) -> MergeReplay:
    return MergeReplay(path)


_SPLIT = regex.compile(PATTERN)


class Encoder:
    """Texts to ids: the distinct words of a batch that are new go through one merge replay; all others are looked up."""

    def __init__(self, path: str):
        self.replay, self.known = replay(path), {}

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text its words' ids."""
        words = [_SPLIT.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = list(set(chain.from_iterable(words)) - self.known.keys())
        block, size = [], 0
        for k, w in enumerate(new):
            block.append(w)
            size += len(w)
            if size > BLOCK_BYTES or k == len(new) - 1:
                self.known.update(zip(block, self.replay.encode([x.encode() for x in block])))
                block, size = [], 0
        known = self.known
        return [[known[w] for w in ws] for ws in words]


def _portions(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that memory doesn't follow the texts' lengths."""
    col = batch.column(column)
    size = np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64))) if len(col) else np.zeros(0, np.int64)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _encode(path: str, only_size: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in _portions(batch, 1):
                coded = encoder.encode(part.column(1).to_pylist())
                sizes = np.array([sum(map(len, words)) for words in coded], np.int64)
                if only_size:
                    value = pa.array(sizes, pa.int64())
                else:
                    flat = np.fromiter(chain.from_iterable(chain.from_iterable(coded)), np.int32, int(sizes.sum()))
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), value], schema=schema)

    return run


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row: its text's ids in order, without special tokens.

    Null and empty texts give the empty list. Strings of special tokens within a text are ordinary text. No shuffle: every
    partition replays the merges over its own distinct words. A row that comes again is coded again.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_encode(f"{folder}/{tokenizer}.tiktoken", False, schema), "key long, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, size: str = "n_tokens") -> DataFrame:
    """(key, number of ids) of every row; 0 for null and empty texts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_encode(f"{folder}/{tokenizer}.tiktoken", True, schema), "key long, n long").select(F.col("key").alias(key), F.col("n").alias(size))


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
