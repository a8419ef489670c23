"""Folds whose state depends on what was kept: plain functions, and grouped pandas functions over documents of bounded size.

A group is to be one document (at most some hundred pages), so that no group grows with the data; callers see to that. Rows are
sorted inside the group by explicit keys.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def longest_steps(values: list[int], most_step: int = 3, anchor: int = 1) -> list[int]:
    """Places of the longest strictly rising subsequence with steps of ``most_step`` at most that begins at the first ``anchor``;
    the earliest wins ties; nothing without an anchor."""
    if anchor not in values:
        return []
    first = values.index(anchor)
    best, prev = {first: 1}, {first: -1}
    #: place of the earliest longest chain that ends at a value
    at = {values[first]: first}
    for i in range(first + 1, len(values)):
        before = [at[v] for v in range(values[i] - most_step, values[i]) if v in at]
        if before:
            j = max(before, key=lambda j: (best[j], -j))
            best[i], prev[i] = best[j] + 1, j
            if values[i] not in at or best[i] > best[at[values[i]]]:
                at[values[i]] = i
    end = max(best, key=lambda i: (best[i], -i))
    out = []
    while end >= 0:
        out.append(end)
        end = prev[end]
    return out[::-1]


def guard(values: list[int], jump: int = 500) -> list[int]:
    """Strictly rising values; one more than ``jump`` above the last kept goes without a trace."""
    out: list[int] = []
    for v in values:
        if not out or 0 < v - out[-1] <= jump:
            out.append(v)
    return out


def overlap(a, b, gap: float = 0.0) -> bool:
    """Whether two boxes (x, y, w, h) overlap once the first is grown by ``gap``."""
    return a[0] - gap < b[0] + b[2] and b[0] < a[0] + a[2] + gap and a[1] - gap < b[1] + b[3] and b[1] < a[1] + a[3] + gap


def union(a, b) -> tuple[float, float, float, float]:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def cluster_boxes(boxes: list, gap: float = 0.006) -> list[tuple]:
    """Boxes by area, largest first (ties in order), each joined to the first cluster that it overlaps, else a cluster of its own;
    clusters never join one another."""
    out: list = []
    for b in sorted(boxes, key=lambda b: -b[2] * b[3]):
        for i, c in enumerate(out):
            if overlap(c, b, gap):
                out[i] = union(c, b)
                break
        else:
            out.append(tuple(b))
    return out


def merge_touching(boxes: list[tuple], kinds: list[str], gap: float = 0.0) -> list[tuple[tuple, str]]:
    """Boxes of one kind that overlap or touch, joined until none do; the first keeps its place."""
    out = list(zip(map(tuple, boxes), kinds))
    i = 0
    while i < len(out):
        j = next((j for j in range(i + 1, len(out)) if out[i][1] == out[j][1] and overlap(out[i][0], out[j][0], gap + 1e-9)), None)
        if j is None:
            i += 1
        else:
            out[i] = union(out[i][0], out[j][0]), out[i][1]
            del out[j]
            i = 0
    return out


def stitch(rows: list[tuple[int | None, str]]) -> list[tuple[int, str, bool]]:
    """Page results (number, text) as items (number, text, review): an equal number continues the last item, a missing or
    lower one gets the next number and a review flag."""
    out: list[list] = []
    for n, text in rows:
        if out and n == out[-1][0]:
            out[-1][1] = f"{out[-1][1]}\n\n{text}"
        elif n is None or (out and n < out[-1][0]):
            out.append([(out[-1][0] if out else 0) + 1, text, True])
        else:
            out.append([n, text, False])
    return [tuple(x) for x in out]


def stitch_answers(rows: list[tuple[int, str]], share: float = 0.85) -> list[tuple[int, str]]:
    """Answers by number from overlapping windows: the first is stored, a repeat is skipped, one alternative is appended."""
    from docloom.functions.rewrite import multiset_share

    first: dict[int, list[str]] = {}
    for n, text in rows:
        got = first.setdefault(n, [])
        if len(got) < 2 and not any(multiset_share(x, text) >= share for x in got):
            got.append(text)
    return [(n, "\n\n---\n\n".join(t)) for n, t in first.items()]


def first_of_each(vectors: np.ndarray, distance: float) -> np.ndarray:
    """Which vectors are kept when one within a mean L1 ``distance`` of an earlier kept one goes."""
    kept: list[int] = []
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if not kept or np.abs(vectors[kept] - v).mean(axis=1).min() >= distance:
            kept.append(i)
            out[i] = True
    return out


def resolve_attempts(attempts: list[tuple[int, str | None, str | None]], most: int = 3) -> tuple[int, str | None, str]:
    """(attempts used, accepted reply, outcome) of (attempt, reply, error) rows: the first without an error wins; two equal errors
    in a row, or ``most`` attempts, end it."""
    last = None
    for used, (_, reply, error) in enumerate(sorted(attempts)[:most], 1):
        if error is None:
            return used, reply, "accepted"
        if error == last:
            return used, None, "stopped"
        last = error
    return min(len(attempts), most), None, "exhausted"


def per_document(rows: DataFrame, by: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """Apply ``fold`` (sorted pandas rows of a document to pandas rows) to each document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return rows.groupBy(*by).applyInPandas(run, schema)


#: Heading marks at the start of a line: 'Question 3', 'Q3', '3.', '03 ', '3)'.
_HEADING = re.compile(r"^[ \t]*(?:\*\*)?(?:(?:question|q)[ .]*(\d{1,4})|0?(\d{1,4})(?=[.)]?\s))", re.I | re.M)
_UNIT = re.compile(r"^\s*(?:[.)]\s*)?(?:marks?|m|cm|mm|km|kg|g|s|v|a|w|n|j|hz|%|°|minutes?|hours?|seconds?)\b", re.I)
#: Footers, best first: total with number and marks, total for the question, marks alone.
_FOOTERS = [
    re.compile(r"total\s+for\s+question\s+(?P<q>\d{1,3})\s*(?:is|:|=)?\s*(?P<m>\d{1,3})\s*marks?", re.I),
    re.compile(r"question\s+(?P<q>\d{1,3})\s*(?:total|[:=])\s*(?P<m>\d{1,3})\s*marks?", re.I),
    re.compile(r"\(total\s+(?P<m>\d{1,3})\s*marks?\)", re.I),
    re.compile(r"\[total:?\s*(?P<m>\d{1,3})\]", re.I),
]


def scan_footer(text: str) -> tuple[int | None, int, float] | None:
    """(number, marks, y) of a page's footer: one with a number before one without, then the lowest; 0 marks do not count. y is the
    share of the page's bytes before it."""
    size = len(text.encode()) or 1
    found = []
    for rank, p in enumerate(_FOOTERS):
        for m in p.finditer(text):
            g = m.groupdict()
            if int(g["m"]):
                found.append((g.get("q") is None, -len(text[: m.start()].encode()) / size, rank, int(g["q"]) if g.get("q") else None, int(g["m"])))
    if not found:
        return None
    _, y, _, q, marks = min(found, key=lambda x: x[:3])
    return q, marks, -y


def heading_veto(text: str, start: int, end: int, number: int) -> str | None:
    """Why a number at a line start is no heading."""
    rest = text[end:]
    line = rest.split("\n", 1)[0]
    if not 1 <= number <= 1000:
        return "range"
    if len(rest.encode()) <= 30:
        return "end of page"
    if re.match(r"\s*\.\s*\d", rest):
        return "sub-part"
    if re.search(r"\[\s*\d+\s*marks?\s*\]\s*$", text[max(0, start - 20) : start], re.I):
        return "after a mark tag"
    if _UNIT.match(line):
        return "quantity"
    if not re.search(r"[^\W\d_]", line):
        return "bare number"
    if re.match(r"\s*(?:of|/)\s*\d", line) or re.match(r"(?i)\s*page\b", text[max(0, start - 8) : start]):
        return "page number"
    if re.match(r"\s*(?:\^|_)", rest) or re.match(r"\s?°", rest):
        return "isotope or degree"
    return None


def scan_headings(text: str) -> list[tuple[int, float]]:
    """(number, y) of the headings of a page."""
    size = len(text.encode()) or 1
    out = []
    for m in _HEADING.finditer(text):
        n = int(m[1] or m[2])
        if heading_veto(text, m.start(), m.end(), n) is None:
            out.append((n, len(text[: m.start()].encode()) / size))
    return out
