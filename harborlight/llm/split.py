"""Problem 4: cutting oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table

LEVELS = ("paragraph", "sentence", "word")
_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
_ENDS = {
    "paragraph": re.compile(rf"{_BREAK}(?:[^\S\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*{_BREAK})+"),
    "sentence": re.compile(rf"[.!?…]+(?=\s)|[。！？]+|{_BREAK}"),
}
_TOKENS = re.compile(r"(\s+)")


class Offsets:
    """A text's tokens (runs of signs and of white space) by prefix sums of their lengths, and its boundaries.

    A level's boundaries are the sorted offsets after which the text may be cut, beside what each of them leaves when white
    space before it is trimmed; both grow together, so the last boundary under a limit is a binary search.
    """

    def __init__(self, text: str):
        self.text = text
        sums = list(accumulate(map(len, _TOKENS.split(text)), initial=0))  # words and white space take turns
        self.size, self._space_start, self._space_end = sums[-1], sums[1:-1:2], sums[2::2]
        self._levels: dict[str, tuple[list[int], list[int]]] = {}

    def level(self, name: str) -> tuple[list[int], list[int]]:
        """A level's boundaries and what they leave."""
        if name not in self._levels:
            ends = self._space_end if name == "word" else [m.end() for m in _ENDS[name].finditer(self.text)]
            self._levels[name] = ends, self._space_start if name == "word" else [self.before(e) for e in ends]
        return self._levels[name]

    def before(self, offset: int) -> int:
        """The offset without the white space before it."""
        k = bisect_left(self._space_start, offset) - 1
        return self._space_start[k] if k >= 0 and self._space_end[k] >= offset else offset

    def after(self, offset: int) -> int:
        """The offset without the white space after it."""
        k = bisect_right(self._space_start, offset) - 1
        return self._space_end[k] if k >= 0 and self._space_end[k] > offset else offset

    def last(self, level: str, start: int, limit: int, least: int, trimmed: bool) -> int | None:
        """The last boundary of a level that keeps the piece from ``start`` within the limit, if it lies beyond ``least``."""
        ends, shown = self.level(level)
        k = bisect_right(shown, self.after(start) + limit) - 1 if trimmed else bisect_right(ends, start + limit) - 1
        return ends[k] if k >= 0 and ends[k] > least else None


def pieces(text: str, limit: int, overlap: int, levels: Sequence[str] = LEVELS, trimmed: bool = False, offsets: Offsets | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of consecutive pieces of at most ``limit`` code points that cover the text.

    A piece ends at the last boundary under the limit of the first of ``levels`` that has one, else hard at the limit
    ('none'). Each piece after the first starts ``overlap`` code points before the end of the one before, or at the first
    word boundary after that point. With ``trimmed``, white space at a piece's ends doesn't count.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    at, out, start = offsets or Offsets(text), [], 0
    n, words = at.size, at.level("word")[0]
    rest = (lambda s: at.before(n) - at.after(s)) if trimmed else (lambda s: n - s)
    while rest(start) > limit:
        least = max(out[-1][1] if out else start, start + overlap)  # a piece must bring something new
        found = next(((end, k) for k in levels if (end := at.last(k, start, limit, least, trimmed)) is not None), None)
        end, kind = found or ((at.after(start) if trimmed else start) + limit, "none")
        out.append((start, end, kind))
        back = end - overlap
        k = bisect_left(words, back)
        start = words[k] if overlap and k < len(words) and words[k] < end else back
    out.append((start, n, "end"))
    return out


def level_pieces(text: str, limit: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The coarsest level whose boundaries alone cut the text without a hard cut, and the pieces; 'none' if hard cuts stay."""
    at, cut = Offsets(text), []
    for level in LEVELS:
        cut = pieces(text, limit, 0, (level,), True, at)
        if all(kind != "none" for _, _, kind in cut):
            return level, cut
    return "none", cut


_SCHEMA = "id long, piece int, start_at int, end_at int, boundary string, level string, text string"
_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("boundary", pa.string()), ("level", pa.string()), ("text", pa.string())])


def _run(limit: int, overlap: int, one_level: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level, cut = level_pieces(text, limit) if one_level else (None, pieces(text, limit, overlap))
                for k, (a, b, kind) in enumerate(cut):
                    rows.append((key, k, a, b, kind, level, text[a:b]))
                    size += b - a
                if size > 4_000_000 or len(rows) > 20_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100, one_level: bool = False) -> DataFrame:
    """The numbered pieces of every text longer than ``limit`` code points.

    Nulls and texts within the limit give no rows; text is never dropped or altered, so the pieces without their
    overlaps join to the text. A key that comes again with the same text gives its pieces once per row. ``one_level`` cuts
    a text without overlap at the coarsest level that alone leaves no piece, trimmed of white space, over the limit, and
    names it in ``level`` ('none' if every level leaves one).
    """
    long = df.where((F.char_length(F.col(text)) > limit) & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    return long.mapInArrow(_run(limit, overlap, one_level), _SCHEMA)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The level at which the pieces of each description over 1,000 code points are cut, one row a description."""
    cut = split_texts(table(spark, sf_dir, "hotels"), "id", "description", one_level=True)
    return cut.select(F.col("id").alias("hotel_id"), F.col("level").alias("boundary")).distinct()


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    """Every piece of those descriptions; a hotel delivered again gives its pieces once."""
    cut = split_texts(table(spark, sf_dir, "hotels"), "id", "description")
    return cut.select(F.col("id").alias("hotel_id"), "piece", "start_at", "end_at", "boundary", "text").dropDuplicates(["hotel_id", "piece"])
