"""Problem 1: the language of documents and of their segments, by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table, table_state
from .canonical import LATIN_TWIN, LOOK_ALIKE

LANGUAGES = ("vi", "en", "fr", "de", "es", "pt", "id", "ru", "ko", "ja", "zh", "th")
UNKNOWN = "und"
#: Bounds of the labelled sample that the classifier is fitted on; everything else covers all rows.
TRAIN_ROWS, TRAIN_SENTENCES = 8_000, 900
WINDOW, EMBEDDING, FILTERS, WIDTHS, EPOCHS = 96, 20, 32, (2, 3, 4), 6
LEAST_STEPS = 240
_LABEL = r"^(?i)([a-z]{2})([-_][a-z]{2})?$"

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}&&[^\s]]+", regex.V1)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]+|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]")
_END = regex.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+|\s[|/]\s")
_THAI_TAIL = regex.compile(r"^(.*[\p{Thai}])(\W*[^\p{Thai}]*)$", regex.S)
_OTHER_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|\p{Cyrillic}{3}")
_LATIN_WORD = regex.compile(r"(?<![\p{L}\d])\p{Latin}[\p{Latin}\p{M}'’-]*")
_LATIN, _LETTER, _NO_LETTER = regex.compile(r"\p{Latin}"), regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_TWINS = str.maketrans(LOOK_ALIKE, LATIN_TWIN)


def visible(text: str) -> str:
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def sentences(text: str) -> list[str]:
    """The sentences of a text that have words. A Thai one, which has no end mark, ends where another language begins."""
    out = []
    for s in _END.split(visible(text)):
        if s and (m := _THAI_TAIL.match(s)) and (_OTHER_SCRIPT.search(m[2]) or len(_LATIN_WORD.findall(m[2])) >= 5):
            parts = [m[1], m[2]]
        else:
            parts = [s or ""]
        out += [p for p in parts if _WORD.search(p)]
    return out


def clean(sentence: str) -> str:
    """What the network sees of a sentence: lower case, look-alike letters of other scripts in Latin text mapped back."""
    if _FOREIGN.search(sentence) and _LATIN.search(sentence):
        plain = unicodedata.normalize("NFC", unicodedata.normalize("NFD", sentence).translate(_TWINS))
        if len(_FOREIGN.findall(plain)) < 0.1 * len(_LETTER.findall(plain)):
            sentence = plain
    return _NO_LETTER.sub(" ", sentence.lower())


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length byte windows of all texts, and the text each belongs to."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        b = t.encode()
        cut = [b[k : k + WINDOW] for k in range(0, max(1, len(b)), WINDOW)]
        if len(cut) > 1 and len(cut[-1]) < WINDOW // 2:  # a short end is seen with what stands before it
            cut[-1] = b[-WINDOW:]
        rows += cut
        owner += [i] * len(cut)
    return np.frombuffer(b"".join(r.ljust(WINDOW, b" ") for r in rows), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


@dataclass
class Network:
    """Byte embedding, filters of several widths, maximum over positions, softmax."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width * EMBEDDING, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, rng: np.random.Generator) -> Network:
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(f32(256, EMBEDDING, scale=0.6), [f32(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f32(FILTERS * len(WIDTHS), len(LANGUAGES), scale=0.1), np.zeros(len(LANGUAGES), np.float32))

    def _responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width's filters at all positions. A filter is a sum over its places, and a place knows 256 bytes: their
        products are looked up, not computed."""
        for w, f in zip(WIDTHS, self.filters):
            n = WINDOW - w + 1
            a = (self.embedding @ f[:EMBEDDING])[x[:, :n]]
            for j in range(1, w):
                a += (self.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING])[x[:, j : j + n]]
            yield a

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """What the softmax sees: the maximum of every filter over the positions."""
        return np.concatenate([np.maximum(a.max(1) + b, 0) for a, b in zip(self._responses(x), self.bias)], 1)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same, and where each maximum lies."""
        pooled, where = [], []
        for a, b in zip(self._responses(x), self.bias):
            at = a.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + b, 0))
            where.append(at)
        return np.concatenate(pooled, 1), where

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        return np.concatenate([self._softmax(self._hidden(x[k : k + batch]) @ self.out + self.out_bias) for k in range(0, len(x), batch)]) if len(x) else np.zeros((0, len(LANGUAGES)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, embed: bool = True, batch: int = 128, rate: float = 3e-3) -> None:
        """Adam on the cross entropy, LEAST_STEPS or more. The gradient of a maximum reaches one patch a filter only."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(x), batch)))
        weights = [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                bytes_, n = x[rows], len(rows)
                h, where = self._pooled(bytes_)
                d = self._softmax(h @ self.out + self.out_bias)
                d[np.arange(n), y[rows]] -= 1
                d /= n
                dh = (d @ self.out.T) * (h > 0)
                de = np.zeros_like(self.embedding)
                df, db = [], []
                for i, w in enumerate(WIDTHS):
                    g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    best = np.concatenate([self.embedding[bytes_[np.arange(n)[:, None], where[i] + j]] for j in range(w)], 2)  # (n, FILTERS, width * EMBEDDING)
                    df.append(np.einsum("nf,nfp->pf", g, best, optimize=True))
                    db.append(g.sum(0))
                    for j in range(w if embed else 0):
                        np.add.at(de, bytes_[np.arange(n)[:, None], where[i] + j].ravel(), (g[:, :, None] * self.filters[i][j * EMBEDDING : (j + 1) * EMBEDDING].T).reshape(-1, EMBEDDING))
                grads = [de, *df, *db, h.T @ d, d.sum(0)]
                step += 1
                for w_, g_, m_, v_ in zip(weights, grads, m, v):
                    m_ += 0.1 * (g_ - m_)
                    v_ += 0.001 * (g_ * g_ - v_)
                    w_ -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)

    def of_label(self, texts: Sequence[str], y: np.ndarray) -> np.ndarray:
        return self._of(texts)[np.arange(len(texts)), y]

    def classify(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence of each text, from the mean log-probability of its windows."""
        p = self._of(texts)
        return p.argmax(1), p.max(1)

    def _of(self, texts: Sequence[str]) -> np.ndarray:
        x, owner = windows(texts)
        logs = np.log(self.probabilities(x) + 1e-9)
        total = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(total, owner, logs)
        return self._softmax(total / np.bincount(owner, minlength=len(texts))[:, None])


def plain_vietnamese(text: str) -> str:
    """Vietnamese as typed without its marks."""
    t = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return t.replace("đ", "d")


_SCRIPTS = {k: regex.compile(p) for k, p in {"ko": r"\p{Hangul}", "ja": r"[\p{Hiragana}\p{Katakana}]", "th": r"\p{Thai}", "ru": r"\p{Cyrillic}", "zh": r"\p{Han}"}.items()}
_VIETNAMESE = regex.compile(r"[ăơưđạ-ỹ]")


def plausible(sentence: str, label: str) -> bool:
    """Whether a sentence's script, or for Latin the share of its words with Vietnamese marks, allows its label."""
    script = next((k for k, p in _SCRIPTS.items() if len(p.findall(sentence)) >= 3), None)
    if script or label in _SCRIPTS:
        return script == label
    words = sentence.split()
    special, marked = sum(bool(_VIETNAMESE.search(w)) for w in words), sum(not w.isascii() for w in words)
    if label == "vi":
        return marked >= 0.35 * len(words)
    return special < 0.4 * len(words) and marked < 0.6 * len(words)


def train(labelled: Sequence[tuple[str, str]], seed: int = 7) -> Network:
    """A network fitted on (text, label) rows whose labels may be wrong and whose texts may mix languages.

    Sentences whose script speaks against the label are left out; one that comes again has its most frequent label; one labelled
    vi without any marks counts only where three labels or more agree. A first fit finds those that the rest of the sample speaks against; the second leaves them out, too, unless three labels or more
    agree on them, and takes as many sentences of each language. Vietnamese sentences take part without their marks, too.
    """
    rng = np.random.default_rng(seed)
    votes: dict[str, Counter[int]] = {}
    for text, label in labelled:
        for s in sentences(text):
            if len(c := clean(s)) > 8 and (plausible(c, label) or (label == "vi" and c.isascii())):
                votes.setdefault(c, Counter())[LANGUAGES.index(label)] += 1
    by: dict[int, list[tuple[str, bool]]] = {i: [] for i in range(len(LANGUAGES))}
    for c, seen in votes.items():
        (k, n), *rest = seen.most_common(2)
        agreed = n >= 3 and n >= 0.75 * seen.total()
        if (not rest or rest[0][1] < n) and (agreed or LANGUAGES[k] != "vi" or not c.isascii()):
            by[k] += [(c, agreed)] * min(n, 3)
    texts, y, sure = [], [], []
    for k, own in by.items():
        vi = LANGUAGES[k] == "vi"
        own = [own[i] for i in rng.permutation(len(own))[: (2 if vi else 3) * TRAIN_SENTENCES]]
        if vi:
            own += [(plain_vietnamese(t), agreed) for t, agreed in own]
        texts += [t for t, _ in own]
        sure += [agreed for _, agreed in own]
        y += [k] * len(own)
    y = np.array(y, np.int64)
    net = Network.start(rng)
    if not len(texts):
        return net
    x, owner = windows(texts)
    net.fit(x, y[owner], 3, rng)
    kept = np.flatnonzero((net.of_label(texts, y) >= 0.35) | np.array(sure))
    if len(kept):
        few = [np.resize(own, max(0, TRAIN_SENTENCES - len(own))) for k in range(len(LANGUAGES)) if len(own := kept[y[kept] == k])]
        kept = np.concatenate([kept, *few])
        first, net = net, Network.start(rng)
        net.embedding = first.embedding  # bytes mean the same; only the filters and the softmax start anew
        x, owner = windows([texts[i] for i in kept])
        net.fit(x, y[kept][owner], EPOCHS, rng, embed=False)
    return net


#: Networks by what they were fitted on, so that queries over one table share a fit.
_FITTED: dict[tuple, Network] = {}
MOST_FITTED = 8


def fit(df: DataFrame, text: str, label: str, key: str, rows: int = TRAIN_ROWS) -> Network:
    """Trains on at most ``rows`` labelled rows, those with the smallest hash of their key; a table that hasn't changed since
    is not trained on again.

    A count gives the bound of the hash below which some more than ``rows`` lie, so that no partition sends more than its
    share of them, however many there are.
    """
    state = table_state(df)
    if state and (net := _FITTED.get((state, text, label, key, rows))):
        return net
    code = F.lower(F.regexp_extract(F.col(label), _LABEL, 1))
    usable = F.col(label).rlike(_LABEL) & code.isin(*LANGUAGES)
    known = df.where(usable & F.col(text).rlike(r"(?U)\S"))
    n = df.where(usable).count()
    least = -(1 << 63)
    bound = least + int((1 << 64) * min(1.0, 1.5 * rows / max(n, 1))) - 1
    some = known.select(F.col(text).alias("t"), code.alias("c"), F.xxhash64(F.col(key), F.lit("sample")).alias("h"), F.col(key).alias("k")).where(F.col("h") <= bound)
    net = train([(r.t, r.c) for r in some.orderBy("h", "k").limit(rows).select("t", "c").collect()])
    if state:
        if len(_FITTED) >= MOST_FITTED:
            _FITTED.clear()
        _FITTED[(state, text, label, key, rows)] = net
    return net


def segments(langs: Sequence[int], confidence: Sequence[float], least: float = 0.5) -> list[tuple[str, float]]:
    """Longest runs of sentences in one language; an unsure sentence belongs to the run around it and starts none, unless all are unsure."""
    sure = [(k, c) for k, c in zip(langs, confidence) if c >= least] or list(zip(langs, confidence))
    out: list[tuple[int, list[float]]] = []
    for k, c in sure:
        if out and out[-1][0] == k:
            out[-1][1].append(c)
        else:
            out.append((k, [c]))
    return [(LANGUAGES[k], float(np.mean(c))) for k, c in out]


_ARROW = pa.schema([("id", pa.int64()), ("label", pa.string()), ("seg", pa.int32()), ("n_segs", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
_SPARK = "id long, label string, seg int, n_segs int, lang string, confidence double"


#: Sentences whose language a task remembers; when there are more, it starts anew.
REMEMBERED = 200_000


def _run(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2_500):
                part = batch.slice(start, 2_500)
                ids, texts, labels = (part.column(i).to_pylist() for i in range(3))
                cut = [[clean(s) for s in sentences(t)] for t in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                distinct = list(dict.fromkeys(s for ss in cut for s in ss if s not in known))
                for k in range(0, len(distinct), 4_000):
                    some = distinct[k : k + 4_000]
                    known.update(zip(some, zip(*(a.tolist() for a in net.classify(some)))))
                rows = []
                for key, label, ss in zip(ids, labels, cut):
                    segs = segments(*zip(*(known[s] for s in ss))) if ss else [(UNKNOWN, 1.0)]
                    rows += [(key, label, k, len(segs), lang, c) for k, (lang, c) in enumerate(segs, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def identify(df: DataFrame, key: str, text: str, label: str, net: Network) -> DataFrame:
    """(id, label, seg, n_segs, lang, confidence): one row per segment of every text, numbered from 1.

    Null and blank texts give no rows; texts without words one segment, und, of confidence 1. A key that comes again gives
    its rows again. Whole texts are read, in windows of fixed length; the network (about 60 KB) goes with the code.
    """
    some = df.where(F.col(key).isNotNull() & F.regexp_replace(F.col(text), r"[\p{Cf}]", "").rlike(r"(?U)\S")).select(F.col(key).cast("long"), F.col(text), F.col(label).cast("string"))
    return some.mapInArrow(_run(net), _SPARK)


def p1_segments(spark, sf_dir: str) -> DataFrame:
    """Every description's segments with language and confidence."""
    hotels = table(spark, sf_dir, "hotels")
    net = fit(hotels, "description", "description_lang", "id")
    return identify(hotels, "id", "description", "description_lang", net).dropDuplicates(["id", "seg"]).select(F.col("id").alias("hotel_id"), "seg", "lang", F.round("confidence", 4).alias("confidence"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The segments of descriptions with a missing or wrong label, with several languages, or without words."""
    hotels = table(spark, sf_dir, "hotels")
    net = fit(hotels, "description", "description_lang", "id")
    found = identify(hotels, "id", "description", "description_lang", net)
    right = F.coalesce(F.col("label").rlike(_LABEL) & (F.lower(F.substring("label", 1, 2)) == F.col("lang")), F.lit(False))
    cases = found.where((F.col("n_segs") > 1) | (F.col("lang") == UNKNOWN) | ~right)
    return cases.select(F.col("id").alias("hotel_id"), "seg", "lang").distinct()
