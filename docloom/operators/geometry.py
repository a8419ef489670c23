"""Boxes as column arithmetic, and pixel tests over luma grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least side in pixels, least and greatest share of the page.
LEAST_SIDE, LEAST_AREA, MOST_AREA = 12, 0.0005, 0.92


def sanitize_box(box: Column, width: Column, height: Column) -> Column:
    """A struct (x, y, w, h) in pixels, or null: values up to 1.5 are shares, up to 100 percents, up to 1.05 of the longer side
    pixels; a third and fourth value beyond the first two that fit the page as a corner are one. Off-page parts are cut; boxes too
    small, too thin or almost the page go."""
    def pixels(m):
        unit = F.when(m["top"] <= 1.5, F.lit(1.0)).when(m["top"] <= 100, F.lit(100.0))
        plain = F.when(m["top"] <= 1.05 * F.greatest(width, height), F.lit(1.0))
        sx, sy = F.coalesce(width / unit, plain), F.coalesce(height / unit, plain)
        return _let(F.struct(*((box[i] * k).alias(n) for i, (n, k) in enumerate((("x", sx), ("y", sy), ("c", sx), ("d", sy))))), corners)

    def corners(p):
        corner = (p["c"] > p["x"]) & (p["d"] > p["y"]) & ((p["x"] + p["c"] > width * 1.02) | (p["y"] + p["d"] > height * 1.02))
        right, low = F.when(corner, p["c"]).otherwise(p["x"] + p["c"]), F.when(corner, p["d"]).otherwise(p["y"] + p["d"])
        x0, y0 = F.greatest(F.lit(0.0), p["x"]), F.greatest(F.lit(0.0), p["y"])
        return _let(F.struct(x0.alias("x"), y0.alias("y"), (F.least(right, width) - x0).alias("w"), (F.least(low, height) - y0).alias("h")), checked)

    def checked(q):
        area = q["w"] * q["h"] / (width * height)
        ok = (q["w"] >= LEAST_SIDE) & (q["h"] >= LEAST_SIDE) & area.between(LEAST_AREA, MOST_AREA)
        return F.when(ok, F.struct(F.floor(q["x"]).cast("int").alias("x"), F.floor(q["y"]).cast("int").alias("y"), F.round(q["w"]).cast("int").alias("w"), F.round(q["h"]).cast("int").alias("h")))

    bad = F.exists(box, lambda v: v.isNull() | F.isnan(v)) | (F.size(box) != 4)
    return F.when(~bad, _let(F.struct(F.array_max(F.transform(box, lambda v: F.abs(v))).alias("top")), pixels))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def box_kind(box: Column) -> Column:
    """tiny, rule (a line), page or figure, of a box in shares of the page."""
    w, h = box[2], box[3]
    area = w * h
    return F.when((w < 0.01) | (h < 0.01), F.when(F.greatest(w, h) > 0.2, "rule").otherwise("tiny")).when(area > 0.5, "page").when(area < 0.002, "tiny").otherwise("figure")


def split_by_caption(boxes: DataFrame, caption: str) -> DataFrame:
    """Boxes (x, y, w, h) whose caption names several figures, in equal parts along their longer side, each with its figure's
    ``figure``; other boxes stay whole, with the one figure they name or none."""
    several = F.col(caption).rlike(r"(?i)\bfig(?:ure)?s?\.?\s*[0-9]+\s*(?:,|&|-|–|and|to)")
    found = F.transform(F.regexp_extract_all(caption, F.lit("([0-9]+)"), 1), lambda n: n.cast("int"))
    one = F.array(F.when(F.size(found) == 1, found[0]))
    out = boxes.withColumn("_all", F.when(several & (F.size(found) >= 2), found).otherwise(one))
    out = out.select("*", F.size("_all").alias("_n"), F.posexplode("_all").alias("_i", "figure"))
    tall = F.col("h") > F.col("w")
    at = F.col("_i") / F.col("_n")
    parts = {
        "x": F.when(tall, F.col("x")).otherwise(F.col("x") + F.col("w") * at),
        "y": F.when(tall, F.col("y") + F.col("h") * at).otherwise(F.col("y")),
        "w": F.when(tall, F.col("w")).otherwise(F.col("w") / F.col("_n")),
        "h": F.when(tall, F.col("h") / F.col("_n")).otherwise(F.col("h")),
    }
    return out.withColumns(parts).drop("_all", "_n", "_i")


def union_boxes(rows: DataFrame, by: list[str], x: str, y: str, w: str, h: str) -> DataFrame:
    """The box around each group's boxes: four partial aggregates."""
    g = rows.groupBy(*by).agg(F.min(x).alias("x"), F.min(y).alias("y"), F.max(F.col(x) + F.col(w)).alias("_r"), F.max(F.col(y) + F.col(h)).alias("_b"))
    return g.withColumns({"w": F.col("_r") - F.col("x"), "h": F.col("_b") - F.col("y")}).drop("_r", "_b")


def mean_l1(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def nearest_caption(boxes: DataFrame, captions: DataFrame, page: str, seq: str) -> DataFrame:
    """The caption nearest to each box's centre on its page; the first in order on a tie. A join on the page, then a combined minimum."""
    c = captions.select(F.col(page).alias("_page"), F.col("cseq"), F.col("cx"), F.col("cy"))
    j = boxes.join(c, boxes[page] == c["_page"])
    d = (F.col("x") + F.col("w") / 2 - F.col("cx")) ** 2 + (F.col("y") + F.col("h") / 2 - F.col("cy")) ** 2
    return j.groupBy(page, seq).agg(F.min(F.struct(d.alias("d"), F.col("cseq").alias("cseq"))).alias("m")).select(page, seq, F.col("m.cseq").alias("cseq"))


def in_band(figures: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Figures with the spans whose pages and band hold their centre: a range join under an equi key on the document."""
    s = spans.select(F.col(doc).alias("_doc"), "number", "start_page", "end_page", "start_y", "end_y")
    cy = F.col("y") + F.col("h") / 2
    low = (F.col("page") > F.col("start_page")) | F.col("start_y").isNull() | (cy >= F.col("start_y"))
    high = (F.col("page") < F.col("end_page")) | F.col("end_y").isNull() | (cy <= F.col("end_y"))
    return figures.join(s, (figures[doc] == s["_doc"]) & F.col("page").between(F.col("start_page"), F.col("end_page")) & low & high).drop("_doc")


def signature(luma: np.ndarray) -> np.ndarray:
    """Mean luma of an 8 by 8 grid."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in luma.shape)
    return np.array([[luma[a:max(b, a + 1), c:max(d, c + 1)].mean() for c, d in zip(cols[:-1], cols[1:])] for a, b in zip(rows[:-1], rows[1:])]).round().astype(int).ravel()


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def is_blank(luma: np.ndarray, share: float = 0.0015, dark: int = 200) -> bool:
    """Fewer than 0.15 % of the samples are dark."""
    return float((luma < dark).mean()) < share


def is_answer_lines(luma: np.ndarray, dark: int = 128) -> bool:
    """Three rows or more that are one run over 80 % of the width."""
    long = [max((b - a for a, b in _runs(r < dark)), default=0) > 0.8 * luma.shape[1] for r in luma]
    return len(_runs(np.array(long))) >= 3


def is_answer_grid(luma: np.ndarray, dark: int = 128) -> bool:
    """Little ink, six ruled rows and two ruled columns, even row heights, and mostly empty bands between."""
    ink = luma < dark
    if ink.mean() > 0.25:
        return False
    rows = _runs(ink.mean(axis=1) > 0.75)
    cols = _runs(ink.mean(axis=0) > 0.65)
    if len(rows) < 6 or len(cols) < 2:
        return False
    gaps = np.diff([(a + b) / 2 for a, b in rows])
    if gaps.std() > 0.15 * gaps.mean():
        return False
    vertical = np.zeros(luma.shape[1], bool)
    for a, b in cols:
        vertical[a:b] = True
    empty = [ink[b:c][:, ~vertical].mean() < 0.02 for (_, b), (c, _) in zip(rows[:-1], rows[1:])]
    return float(np.mean(empty)) >= 0.8


def pixel_flags(pages: DataFrame, key: str, pixels: str, width: str, height: str) -> DataFrame:
    """key, blank, lines, grid of luma images (8-bit bytes, row by row), in Arrow batches."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for k, raw, w, h in zip(pdf[key], pdf[pixels], pdf[width], pdf[height]):
                a = np.frombuffer(raw, np.uint8).reshape(h, w)
                blank = is_blank(a)
                out.append((k, blank, not blank and is_answer_lines(a), not blank and is_answer_grid(a)))
            yield pd.DataFrame(out, columns=[key, "blank", "lines", "grid"])

    return pages.select(key, pixels, width, height).mapInPandas(run, f"{key} long, blank boolean, lines boolean, grid boolean")
