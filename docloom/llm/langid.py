"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Each word's letters name its script; only languages that the training text writes in that script compete for it. A word's score
in a language is the log-likelihood of its letter n-grams (borders included) under a smoothed model. Viterbi finds the best
sequence of languages under a penalty for each switch; runs of one language are the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, worker_cache, written

#: Documents of each language that the model is fitted on at most.
FIT_ROWS = 600
ORDER, SMOOTH = 4, 0.5
SWITCH = 24.0
UNKNOWN = "und"
#: A word counts against a language by this at most.
FLOOR = -30.0
CACHED_WORDS = 1 << 19
#: Words of one Viterbi block at most (documents times the longest one's words).
CELLS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: First code points of Unicode script ranges and their scripts.
_SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Indic"), (0xE00, "Thai"), (0xE80, "Lao"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x3040, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other")]
_STARTS = [s for s, _ in _SCRIPTS]


def words_of(text: str) -> list[str]:
    """The runs of letters in lower case; other numbers that count as word characters ('½', '²', 'Ⅷ') part words."""
    ws = _WORD.findall(text.lower())
    if not ws or "".join(ws).isalpha():
        return ws
    return [part for w in ws for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def script(word: str) -> str:
    """The script of the word's first letter outside Latin, else Latin."""
    from bisect import bisect_right

    for c in word:
        if (s := _SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1]) != "Latin":
            return s
    return "Latin"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)][1:]


class Model:
    def __init__(self, rows: list[tuple[str, str]]):
        """Learn from (text, lang) rows."""
        self.langs = sorted({lang for _, lang in rows})
        counts = {lang: [Counter() for _ in range(ORDER + 1)] for lang in self.langs}
        scripts: dict[str, Counter] = {}
        for text, lang in rows:
            for w, n in Counter(words_of(text)).items():
                scripts.setdefault(script(w), Counter())[lang] += n
                for g in grams(w):
                    counts[lang][len(g)][g] += n
        #: Languages that write at least one word in a hundred thousand of their text in the script.
        size = {lang: 1 + sum(c[lang] for c in scripts.values()) for lang in self.langs}
        self.of_script = {s: np.array([c[lang] > 1e-5 * size[lang] for lang in self.langs]) for s, c in scripts.items()}
        self.width = len(self.langs)
        self.places: dict[str, int] = {}
        table = [np.zeros((1, self.width), np.float32)]
        for n in range(1, ORDER + 1):
            sums = np.array([sum(counts[lang][n].values()) for lang in self.langs], float)
            every = set().union(*(counts[lang][n] for lang in self.langs)) if self.langs else set()
            # n-grams seen once in all carry little and would fill memory
            every = sorted(g for g in every if n < 3 or sum(counts[lang][n][g] for lang in self.langs) > 1)
            seen = np.array([[counts[lang][n][g] for lang in self.langs] for g in every], float).reshape(len(every), self.width)
            self.places.update((g, sum(map(len, table)) + i) for i, g in enumerate(every))
            table.append(np.log((seen + SMOOTH) / (sums + SMOOTH * (len(every) + 1))).astype(np.float32))
        #: a row for each known n-gram; row 0, of unknown ones, favours no language
        self.table = np.concatenate(table)
        self.key = int(np.abs(self.table).sum() * 1e3)

    def words(self, ws: list[str]) -> np.ndarray:
        """Scores of words in each language, less the best; languages of other scripts are far behind."""
        get = self.places.get
        at: list[int] = []
        starts = []
        for w in ws:
            starts.append(len(at))
            at += [get(g, 0) for g in grams(w)]
        s = np.add.reduceat(self.table[at], starts, axis=0)
        s -= s.max(1, keepdims=True)
        for i, w in enumerate(ws):
            if (m := self.of_script.get("Latin" if w.isascii() else script(w))) is not None and m.any() and not m.all():
                s[i] = np.where(m, s[i] - s[i][m].max(), FLOOR)
        return np.maximum(s, FLOOR)

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text: (language, first word, letters), in order."""
        split = [words_of(t) for t in texts]
        held = worker_cache(("language", self.key), dict)
        known = held.setdefault("known", {})
        if len(known) > CACHED_WORDS:
            known.clear()
        if not known:
            held["flat"] = np.zeros((1 << 16, self.width), np.float32)
        self._flat = held["flat"]
        new = list({w for ws in split for w in ws if w not in known})
        for i in range(0, len(new), 5000):
            part, k = new[i : i + 5000], len(known)
            while k + len(part) > len(self._flat):
                self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
            self._flat[k : k + len(part)] = self.words(part)
            known.update(zip(part, range(k, k + len(part))))
        held["flat"] = self._flat
        out: list = [[] for _ in texts]
        order = []
        for i, ws in enumerate(split):
            if ws:
                one = self._single(self._flat[[known[w] for w in ws]])
                if one is None:
                    order.append(i)
                else:
                    out[i] = [(one, 0, sum(map(len, ws)))]
        order.sort(key=lambda i: len(split[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(split[order[-1]]) <= CELLS:
                n += 1
            block, order = order[-n:], order[:-n]
            for i, path in zip(block, self._viterbi([np.array([known[w] for w in split[i]]) for i in block])):
                cut = np.flatnonzero(np.diff(path)) + 1
                sizes = np.array([len(w) for w in split[i]])
                out[i] = [(int(path[a]), int(a), int(sizes[a:b].sum())) for a, b in zip([0, *cut], [*cut, len(path)])]
        return out

    def _single(self, scores: np.ndarray) -> int | None:
        """The language of the whole text if one span certainly is Viterbi's answer, else None.

        With k spans of other languages a path gains at most k times the best stretch of any of them and pays k - 1 switches at
        least; if no stretch gains more than half a switch, no path beats the best single language.
        """
        total = scores.sum(0)
        best = int(total.argmax())
        upto = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(upto, axis=0), 0)
        # the least sum before each word, the empty one included
        gain = upto.max(initial=0) if len(upto) == 1 else max(float((upto[1:] - low[:-1]).max()), float(upto[0].max()))
        return best if gain <= SWITCH / 2 else None

    def _viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Best language of each word; all documents of the block step together."""
        n, longest = len(docs), max(map(len, docs))
        at = np.full((n, longest), -1)
        for i, d in enumerate(docs):
            at[i, : len(d)] = d
        lens = np.array([len(d) for d in docs])
        best = np.zeros((n, self.width), np.float32)
        switched = np.zeros((longest, n, self.width), bool)
        lead = np.zeros((longest, n), np.int16)
        for t in range(longest):
            top = best.argmax(1)
            high = best[np.arange(n), top][:, None] - SWITCH
            lead[t], switched[t] = top, best < high
            live = at[:, t] >= 0
            best = np.where(live[:, None], np.maximum(best, high) + self._flat[at[:, t]], best)
        paths = np.zeros((n, longest), np.int16)
        state = best.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            paths[:, t] = state
            live = lens > t
            state = np.where(live & switched[t][rows, state], lead[t], state)
        return [p[:k] for p, k in zip(paths, lens)]

    def predict(self, text_spans: list[tuple[int, int, int]]) -> tuple[str, float]:
        """The language with most letters (first in order on a tie) and its share of the letters."""
        if not text_spans or not self.langs:
            return UNKNOWN, 0.0
        letters = np.bincount([s[0] for s in text_spans], [s[2] for s in text_spans], minlength=self.width)
        return self.langs[int(letters.argmax())], float(letters.max() / letters.sum())


def labelled(docs: DataFrame, residue: int = 2, folds: int = 4) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) rows outside the held-out fold: of each language the FIT_ROWS documents of least hash.

    One scan counts the languages' documents, another takes the documents whose hash lies below twice the share that is wanted, so the
    ranking sees so many of a language at most, however large it is. Of several texts under one doc_id one is taken.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != residue)
    # a row for each language; written, so that its size decides whether it is broadcast
    sizes = written(known.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("doc_id").alias("n")), "languages")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    some = known.join(sizes, F.col("lang") == F.col("of")).filter(place < (2 * FIT_ROWS + 50) / F.col("n"))
    each = some.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FIT_ROWS)
    return [(r[0], r[1]) for r in chosen.select("t.text", "lang").collect()]


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the predicted language's share of the letters) for each row of ``docs``; with
    ``spans`` also the spans as an array of (lang, first_word, letters).

    Null texts and texts without letters are ``und`` with score 0. Rows are independent; ties go to the first language in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,first_word:int,letters:int>>" * spans
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for b in (whole.slice(i, 4000) for i in range(0, whole.num_rows, 4000)):
                found = m.label([t or "" for t in b.column("text").to_pylist()]) if m.langs else [[]] * b.num_rows
                said = [m.predict(s) for s in found]
                cols = [b.column("doc_id"), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
                if spans:
                    cols.append(pa.array([[{"lang": m.langs[x[0]], "first_word": x[1], "letters": x[2]} for x in s] for s in found], kind))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
