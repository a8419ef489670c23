"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary's trie gets failure links: where no child fits, the pieces that greedy matching would have cut off by then are
popped and matching resumes at the link's node, which stands for the text that is left. Each node holds how many pieces its
popping yields, so a word's greedy piece count comes from one pass over its symbols without building a piece.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, worker_cache

#: Fixed value: the pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
CACHED_WORDS = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """A trie over symbol tuples with failure links and popped-piece counts; symbol 256 ends a word."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        child: dict[int, int] = {}
        whole, depth = [False], [()]
        for piece in pieces:
            v = 0
            for c in piece:
                k = v << 9 | c
                if k not in child:
                    child[k] = len(whole)
                    whole.append(False), depth.append((v, c))
                v = child[k]
            whole[v] = True
        n = len(whole)
        down: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, v in child.items():
            down[k >> 9].append((k & 511, v))
        fail, popped = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in down[u]:
                if whole[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    z, count = fail[u], popped[u]
                    while z >= 0 and (z << 9 | c) not in child:
                        count += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = child[z << 9 | c], count
                todo.append(v)
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, symbols) -> int | None:
        """Pieces of greedy longest match over ``symbols`` and the end mark; None where no piece fits."""
        child, fail, popped = self.child, self.fail, self.popped
        v, n = 0, 0
        for c in symbols:
            while (u := child.get(v << 9 | c)) is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return None
            v = u
        while (u := child.get(v << 9 | 256)) is None:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return None
        return n + 1


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        pieces = []
        for p in vocabulary:
            body, end = (p[: -len(END)], (256,)) if p.endswith(END) else (p, ())
            if all(c in letters for c in body):
                pieces.append((*(letters[c] for c in body), *end))
        self.automaton = Automaton(pieces)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of one white-space-separated word; a pre-token that no pieces fit counts one."""
        w = unicodedata.normalize("NFC", w)
        w = w.lower() if w.isascii() else "".join(c.lower() for c in w)
        return sum(self.automaton.count(p.encode("utf-8", "surrogatepass")) or 1 for p in self.find(w))

    def text(self, t: str) -> int:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        total = 0
        for w in t.split():
            n = known.get(w)
            if n is None:
                n = known[w] = self.word(w)
            total += n
        return total


def counter(path: str) -> Counter:
    return worker_cache(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every whole text under the vocabulary file at ``path`` (the same place on every machine).

    Null and empty texts have 0 tokens. Rows are independent, so repeated rows repeat; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.text(t or "") for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
