"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared over windows.

A window is a run of WIDTHS words. zstandard matches whole bytes, three at least, which is too coarse for short words, so each
letter is written as four bytes that stand for it and the letters of its word before it: words match from their beginning, as far
as they agree. The ordinary dictionary is trained on windows of the whole ordinary texts; the toxic one holds the same and what
training on windows of the toxic texts adds, taken from those that the ordinary one compresses worst. In some rounds more is
then trained on the windows where the two differ: ordinary ones first, so that the ordinary dictionary learns what the toxic one
should not know, toxic ones after. A window's signal is its length under the ordinary dictionary less that under the toxic one.
How often signals pass calibrated thresholds enters a logistic model whose output is the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, release, worker_cache

#: Rows of each label that the model is fitted on at most, taken in the order of a hash of doc_id.
FIT_TOXIC, FIT_ORDINARY = 2400, 6000
#: Words of a window, and the forms that are tried: words, bytes of the ordinary dictionary, bytes that toxic text adds and the share
#: of its windows that it adds them from, rounds, and the bytes that each round adds for ordinary and for toxic windows.
FORMS = ((3, 32 << 10, 4 << 10, 0.3, 0, 0, 0), (4, 32 << 10, 4 << 10, 0.3, 0, 0, 0), (4, 64 << 10, 32 << 10, 0.5, 3, 128 << 10, 16 << 10))
#: Bytes of windows that a dictionary is trained on at most, spread over all texts, and windows of a training sample.
TRAINED, SAMPLED = 16 << 20, 8
#: Signals (bytes) of the windows of a round, ordinary and toxic, and thresholds that are counted.
HARD, CLEAR, SIGNALS = 6, 8, (4, 8, 12, 16, 20, 26)
#: A word's letters beyond so many are coded like the last one.
LETTERS = 64
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_POWERS = np.array([pow(2654435761, i, 1 << 32) for i in range(LETTERS)], np.uint32)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def coded(texts: list[str], width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The codes of all windows, the bytes of each window, and the windows of each text."""
    flat, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words(t)
        flat += [" " + " ".join(ws[j : j + width]) + " " for j in range(0, len(ws), width)]
        counts[i] = -(-len(ws) // width)
    if not flat:
        return b"", np.zeros(0, np.int64), counts
    a = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = a == 32
    x = (a + np.uint32(1)) * np.uint32(2246822519)
    x ^= x >> np.uint32(15)
    x[space] = 0
    # a sum over the word's letters so far
    place = np.arange(len(a), dtype=np.int32)
    start = np.maximum.accumulate(np.where(space, place, 0))
    k = np.minimum(place - start, LETTERS - 1)
    upto = np.cumsum(x * _POWERS[k], dtype=np.uint32)
    h = (upto - upto[start]) * np.uint32(3266489917) + k.astype(np.uint32) * np.uint32(668265263)
    h ^= h >> np.uint32(16)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    return h.tobytes(), np.fromiter(map(len, flat), np.int64, len(flat)) * 4, counts


class Dictionary:
    """Lengths of windows under one dictionary."""

    def __init__(self, data: bytes):
        import zstandard

        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=3)
        p = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.compress = zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def lengths(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        view, compress, at, out = memoryview(raw), self.compress, 0, []
        for n in sizes.tolist():
            out.append(len(compress(view[at : at + n])))
            at += n
        return np.array(out, np.int64)


class Scorer:
    """Dictionaries and weights; made by ``fit``, sent to the workers as plain bytes and arrays."""

    def __init__(self, width: int, toxic: bytes, ordinary: bytes, weights: np.ndarray):
        self.width, self.toxic, self.ordinary, self.weights = width, toxic, ordinary, weights
        self.key = zlib.crc32(toxic + ordinary)

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text and threshold: whether a window's signal passes it, how many do and their share; and the signals' highest,
        sum, sum of positive ones, and the text's size."""
        t, o = worker_cache(("toxicity", self.key), lambda: (Dictionary(self.toxic), Dictionary(self.ordinary)))
        raw, sizes, counts = coded(texts, self.width)
        signal = o.lengths(raw, sizes) - t.lengths(raw, sizes)
        out = np.zeros((len(texts), N_FEATURES))
        upto = np.concatenate([[0], np.cumsum(counts)])
        for i, n in enumerate(counts.tolist()):
            s = signal[upto[i] : upto[i + 1]]
            for j, least in enumerate(SIGNALS):
                c = np.count_nonzero(s >= least)
                out[i, 3 * j : 3 * j + 3] = min(c, 1), np.log1p(c), 10 * c / (n + 10)
            out[i, -5:] = s.max(initial=0) / 10, s.sum() / (n + 10), s.clip(0).sum() / (n + 10), np.log1p(n) / 8, 1.0
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


N_FEATURES = 3 * len(SIGNALS) + 5


def _parts(texts: list[str], n: int = 100) -> Iterator[list[str]]:
    yield from (texts[i : i + n] for i in range(0, len(texts), n))


class _Windows:
    """The coded windows of some texts."""

    def __init__(self, texts: list[str], width: int):
        self.raw, sizes = bytearray(), []
        for p in _parts(texts):
            raw, n, _ = coded(p, width)
            self.raw += raw
            sizes.append(n)
        self.sizes = np.concatenate(sizes)
        self.ends = np.cumsum(self.sizes)

    def lengths(self, d: Dictionary) -> np.ndarray:
        return d.lengths(self.raw, self.sizes)

    def train(self, size: int, picked: np.ndarray) -> bytes:
        """A dictionary of ``size`` bytes trained on the picked windows, or a random TRAINED bytes of them."""
        import zstandard

        at = np.random.default_rng(1).permutation(np.flatnonzero(picked))
        at = at[: int(np.searchsorted(np.cumsum(self.sizes[at]), TRAINED)) + 1]
        view = memoryview(self.raw)
        own = [bytes(view[e - n : e]) for e, n in zip(self.ends[at].tolist(), self.sizes[at].tolist())]
        try:
            return zstandard.train_dictionary(size, [b"".join(own[i : i + SAMPLED]) for i in range(0, len(own), SAMPLED)], k=64, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the windows themselves
            return b"".join(own)[-size:]


def _content(dictionary: bytes, size: int) -> bytes:
    """A trained dictionary's content without its entropy tables, which fit in its first bytes."""
    return dictionary[-(size - 256) :]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-9))
    return w


def _dictionaries(toxic: list[str], ordinary: list[str], form: tuple) -> Iterator[tuple[bytes, bytes]]:
    """The toxic and the ordinary dictionary of a form, after each of its rounds."""
    width, size, added, share, rounds, per_ordinary, per_toxic = form
    t, o = _Windows(toxic, width), _Windows(ordinary, width)
    plain = o.train(size, np.ones(len(o.sizes), bool)) or b"\0" * 8
    d = Dictionary(plain)
    left = t.lengths(d) / np.maximum(t.sizes, 1)
    worst = left >= np.quantile(left, 1 - share) if len(left) else np.zeros(0, bool)
    both = plain + _content(t.train(added, worst), added)
    if not rounds:
        yield both, plain
    for _ in range(rounds):
        hard = o.lengths(Dictionary(plain)) - o.lengths(Dictionary(both)) >= HARD
        clear_under = Dictionary(both)
        plain += _content(o.train(per_ordinary, hard), per_ordinary)
        clear = t.lengths(Dictionary(plain)) - t.lengths(clear_under) >= CLEAR
        both = plain + _content(t.train(per_toxic, clear), per_toxic)
        yield both, plain


def fit(rows: list[tuple[str, int]]) -> Scorer:
    """Train on (text, toxic) rows: dictionaries on two thirds, weights on the rest; the form that separates the rest best is kept.

    Without two rows of both labels every score is the share of toxic rows, 0 or 1.
    """
    rows = sorted({(t or "", int(y)) for t, y in rows})
    held = lambda t: zlib.crc32(b"calibrate" + t.encode("utf-8", "surrogatepass")) % 3 == 0
    toxic, ordinary = ([t for t, y in rows if (y == 1) == want and not held(t) and words(t)] for want in (True, False))
    texts, y = [t for t, _ in rows if held(t)], np.array([v == 1 for t, v in rows if held(t)], float)
    if len(toxic) < 2 or len(ordinary) < 2 or not 0 < y.sum() < len(y):
        w = np.zeros(N_FEATURES)
        w[-1] = 30 if rows and all(v == 1 for _, v in rows) else -30
        return Scorer(FORMS[0][0], b"\0" * 8, b"\0" * 8, w)
    best = None
    for form in FORMS:
        for t, o in _dictionaries(toxic, ordinary, form):
            s = Scorer(form[0], t, o, np.zeros(N_FEATURES))
            x = np.concatenate([s.features(p) for p in _parts(texts)])
            s.weights = _logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ s.weights, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if best is None or loss < best[0]:
                best = (loss, s)
    release()
    return best[1]


def labelled(docs: DataFrame, labels: DataFrame, residue: int = 1, folds: int = 3) -> list[tuple[str, int]]:
    """The bounded sample of (text, toxic) rows outside the held-out fold: one text for each of FIT_TOXIC + FIT_ORDINARY ids at most.

    An id with both labels is toxic; of several texts under one id the one of the least hash is taken.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != residue)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = known.filter("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(known.filter("toxic <> 1").orderBy(*order).limit(FIT_ORDINARY))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    each = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return [(r[0], r[1]) for r in each.select("t.text", "toxic").collect()]


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` (any columns, with ``text``) and a column ``score``: 0 to 1, higher for toxic text, over whole texts.

    Null and empty texts get the score of a text without words. Rows are independent: repeated rows get equal scores. A column
    named ``score`` is replaced. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                texts = [t or "" for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sent.value.score(texts), pa.float64())], names=[*kept, "score"])

    return bounded(docs).select(*kept).mapInArrow(run, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "score"), "score double"]))
