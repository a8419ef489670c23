"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores the copies.

Each word trigram of an item is a seed, however common. Around each seed the item is aligned, word by word, with as much of the
document as a copy through that seed can take with all the insertions that its score allows; insertions, deletions and replaced
words cost points. Stretches that share too few words with the item for a copy are not aligned. A copy without three words of
the item in a row is not found. Items of fewer than LEAST_WORDS words, which count only as a whole,
are searched unless chance makes them: the product of their words' corpus frequencies, not counting the words of the item's own
verbatim copies (so that a leak that many documents share does not hide itself), is more than RARE. The benchmark is taken in
blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, written

SEED_WORDS = 3
#: A short item's chance by its words' frequencies, at most.
RARE = 1e-7
MATCH, MISMATCH, GAP = 2, -1, -1
#: A copy: points over those of a full match of the item, or those of so many words in a row; words matched at least.
SCORE, PART_WORDS, LEAST_WORDS = 0.5, 50, 10
#: Items of a block, which is broadcast (words of items beyond ITEM_WORDS count towards more blocks).
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman of two word-id arrays: best score, matched words on its path, and the path's range in ``part``."""
    at = np.arange(len(part) + 1)
    steps = at * -GAP
    h, begun, hits = np.zeros_like(at), at, np.zeros_like(at)
    best = (0, 0, 0, 0)
    for word in item:
        same = part == word
        across, down = h[:-1] + np.where(same, MATCH, MISMATCH), h[1:] + GAP
        slant = across >= down
        row = np.concatenate([[0], np.maximum(np.where(slant, across, down), 0)])
        # where the path of each cell began, and its matched words
        begun = np.where(row > 0, np.concatenate([[0], np.where(slant, begun[:-1], begun[1:])]), at)
        hits = np.where(row > 0, np.concatenate([[0], np.where(slant, hits[:-1] + same, hits[1:])]), 0)
        top = np.maximum.accumulate(row + steps)
        source = np.maximum.accumulate(np.where(row + steps == top, at, 0))
        h, begun, hits = top - steps, begun[source], hits[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(hits[j]), int(begun[j]), j)
    return best


def bound(known: np.ndarray) -> int:
    """What an alignment of some stretch can score at most, by which of its side's words the other side has at all."""
    upto = np.concatenate([[0], np.cumsum(np.where(known, MATCH, max(MISMATCH, GAP)))])
    return int((upto - np.minimum.accumulate(upto)).max())


class Items:
    """A block of test items by their position in it: ids, word numbers, and the seeds' places."""

    def __init__(self, rows: list[tuple[int | None, str]], common: set[tuple[str, ...]]):
        """Items whose words are in ``common`` are not searched."""
        self.ids = [i for i, _ in rows]
        split = dict(enumerate(words(t) for _, t in rows))
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split.values() for w in ws))}
        v = len(self.vocabulary)
        self.items = {i: np.array([self.vocabulary[w] for w in ws]) for i, ws in split.items() if ws}
        seeds = defaultdict(list)
        for i, ids in self.items.items():
            if tuple(split[i]) in common:
                continue
            for at in range(len(ids) - SEED_WORDS + 1):
                part = ids[at : at + SEED_WORDS]
                seeds[(int(part[0]) * v + int(part[1])) * v + int(part[2])].append((i, at))
        self.v, self.keys = v, np.array(sorted(seeds), np.int64)
        self.places = [seeds[k] for k in self.keys.tolist()]
        #: marks of words, all False between uses; the last one is of unknown words
        self.marks = np.zeros(v + 1, bool)

    def search(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(position of the item, share of the full score, matched words, first and last word) of the best copy of each item in the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        if len(ids) < SEED_WORDS or not len(self.keys):
            return []
        key = (ids[:-2] * self.v + ids[1:-1]) * self.v + ids[2:]
        key[(ids[:-2] < 0) | (ids[1:-1] < 0) | (ids[2:] < 0)] = -1
        some = np.flatnonzero(key >= 0)
        k = np.searchsorted(self.keys, key[some])
        ok = self.keys[np.minimum(k, len(self.keys) - 1)] == key[some]
        hits = defaultdict(set)
        for at, place in zip(some[ok].tolist(), k[ok].tolist()):
            for item, of in self.places[place]:
                hits[item].add(at - of)
        found = []
        self.marks[ids] = True
        hits = {i: starts for i, starts in hits.items() if bound(self.marks[self.items[i]]) >= needed(len(self.items[i]))}
        self.marks[ids] = False
        for item, starts in hits.items():
            ids_i, best = self.items[item], None
            m, need = len(ids_i), needed(len(ids_i))
            # a copy has so many inserted words at most, and takes so many words of the document
            extra = int((MATCH * m - need) / -GAP)
            reach = m + extra
            self.marks[ids_i] = True
            known = self.marks[ids]
            self.marks[ids_i] = False
            todo = sorted(starts)
            while todo:
                first = last = todo.pop(0)
                while todo and todo[0] - last <= reach + extra:
                    last = todo.pop(0)
                # each copy is whole in one of the overlapping windows
                end = min(len(ids), last + reach)
                for lo in range(max(0, first - extra), end, reach):
                    hi = min(end, lo + 2 * reach)
                    self.marks[ids[lo:hi]] = True
                    met = self.marks[ids_i]
                    self.marks[ids[lo:hi]] = False
                    if bound(known[lo:hi]) >= need and bound(met) >= need:
                        score, matched, a, b = align(ids_i, ids[lo:hi])
                        if best is None or score > best[0]:
                            best = (score, matched, lo + a, lo + b)
                    if hi == end:
                        break
            if best:
                found.append((item, best[0] / (MATCH * m), *best[1:]))
        return found


def needed(item_words: int) -> float:
    """The points of a copy of an item, at least."""
    return MATCH * min(SCORE * item_words, PART_WORDS)


def copied(share: float, matched: int, item_words: int) -> bool:
    return matched >= min(LEAST_WORDS, item_words) and round(share * MATCH * item_words) >= needed(item_words)


def _by_chance(docs: DataFrame, items: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Those of ``items`` (of SEED_WORDS words or more) that chance makes from the words the documents hold outside their copies."""
    if not items:
        return set()
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = {w for item in sent.value for w in item}, defaultdict(list)
        for item in sent.value:
            heads[item[:SEED_WORDS]].append((item, " ".join(item)))
        total, found = 0, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                ws, end = words(t), {}
                total += len(ws)
                found.update(w for w in ws if w in known)
                for at, head in enumerate(zip(*(ws[i:] for i in range(SEED_WORDS)))):
                    for item, name in heads.get(head, ()):
                        if at >= end.get(name, 0) and tuple(ws[at : at + len(item)]) == item:
                            found[name] += 1
                            end[name] = at + len(item)
        yield pa.RecordBatch.from_arrays([pa.array(["", *found]), pa.array([total, *found.values()], pa.int64())], names=["words", "n"])

    got = docs.select("text").mapInArrow(run, "words string, n long").groupBy("words").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    counts = {r["words"]: r["n"] for r in got}
    total = max(1, counts.get("", 0))
    chance = {item: np.prod([(counts.get(w, 0) - counts.get(" ".join(item), 0) * item.count(w)) / total for w in item]) for item in items}
    return {item for item, x in chance.items() if x > RARE}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 4
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, item_id, score (share of the item's full alignment score), matched (words), first_word, last_word, item_words of each
    document that holds a copy of a benchmark item or of PART_WORDS words of it; with ``every`` all candidates that were aligned.

    Whole texts are searched. Null and empty texts and items match nothing, nor do items of fewer than SEED_WORDS words and
    items below LEAST_WORDS words that chance makes. Repeated rows repeat; items with equal ids are searched each, and those without an id too. Empty tables give an empty result; extra columns are ignored.
    """
    out = None
    spark = bounded(docs).sparkSession
    schema = "doc_id long, item_id long, score double, matched int, first_word int, last_word int, item_words int"
    for block in _blocks(benchmark):
        short = {ws for _, t in block if SEED_WORDS <= len(ws := tuple(words(t))) < LEAST_WORDS}
        sent = spark.sparkContext.broadcast(Items(block, _by_chance(docs, short)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, kinds = sent.value, [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            for b in batches:
                rows = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, share, matched, a, z in items.search(t):
                        if every or copied(share, matched, len(items.items[item])):
                            rows.append((i, items.ids[item], share, matched, a, z, len(items.items[item])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "score", "matched", "first_word", "last_word", "item_words"])

        found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "leaks")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item; rows without a doc_id stay."""
    gone = written(leaks(docs, benchmark).select("doc_id").distinct(), "leaked-ids")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
