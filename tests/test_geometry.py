import numpy as np
from pyspark.sql import functions as F

from docloom.operators import folds, geometry


def test_pixels():
    blank = np.full((120, 100), 255, np.uint8)
    lines = blank.copy()
    lines[10::14] = 0
    grid = lines.copy()
    grid[:, [5, 50, 95]] = 0
    assert [f(x) for x in (blank, lines, grid) for f in (geometry.is_blank, geometry.is_answer_lines, geometry.is_answer_grid)] == [True, False, False, False, True, False, False, True, True]
    ragged = blank.copy()
    ragged[[5, 9, 30, 50, 90, 115]] = 0
    ragged[:, [5, 95]] = 0
    assert not geometry.is_answer_grid(ragged)


def test_signature():
    a = np.arange(64 * 64, dtype=np.uint8).reshape(64, 64)
    s = geometry.signature(a)
    assert s.shape == (64,) and s[0] == round(a[:8, :8].mean())
    assert np.abs(geometry.signature(a) - geometry.signature(np.minimum(a, 250))).mean() < 4


def test_first_of_each():
    v = np.array([[0.0, 0.0], [0.1, 0.1], [5.0, 5.0], [5.0, 5.1], [0.0, 3.0]])
    assert folds.first_of_each(v, 1.0).tolist() == [True, False, True, False, True]


def test_boxes(spark):
    cases = [([0.1, 0.1, 0.3, 0.3], (100, 80, 300, 240)), ([10.0, 10.0, 30.0, 30.0], (100, 80, 300, 240)), ([100.0, 80.0, 300.0, 240.0], (100, 80, 300, 240)), ([600.0, 500.0, 900.0, 700.0], (600, 500, 300, 200)), ([0.0, 0.0, 0.001, 0.5], None), ([0.9, 0.9, 0.5, 0.5], (900, 720, 100, 80)), ([float("nan"), 0.1, 0.2, 0.2], None), ([0.0, 0.0, 1.0, 1.0], None), ([1.0, 2.0, 3.0], None), ([5000.0, 1.0, 2.0, 3.0], None)]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b array<double>")
    got = [r["o"] for r in rows.select("i", geometry.sanitize_box(F.col("b"), F.lit(1000), F.lit(800)).alias("o")).orderBy("i").collect()]
    assert [tuple(o) if o else None for o in got] == [want for _, want in cases]


def test_nearest_caption_takes_the_first_on_a_tie(spark):
    boxes = spark.createDataFrame([(1, 1, 0.25, 0.25, 0.5, 0.5), (2, 1, 0.0, 0.0, 0.1, 0.1)], "page int, seq int, x double, y double, w double, h double")
    captions = spark.createDataFrame([(1, 7, 0.5, 0.75), (1, 3, 0.5, 0.25)], "page int, cseq int, cx double, cy double")
    assert [tuple(r) for r in geometry.nearest_caption(boxes, captions, "page", "seq").collect()] == [(1, 1, 3)]


def test_merge_touching():
    got = folds.merge_touching([(0, 0, 1, 1), (3, 3, 1, 1), (1, 0, 2, 1), (0, 0, 1, 1)], ["a", "a", "a", "b"])
    assert got == [((0, 0, 3, 1), "a"), ((3, 3, 1, 1), "a"), ((0, 0, 1, 1), "b")]


def test_figure_detection_equals_plain_python(spark):
    import math

    from docloom.operators import folds
    from docloom.plans import QUERIES
    from docloom.plans.sequences import boxes

    sf = "/root/testdata/sf0.001"
    pages = {}
    for r in boxes(spark, sf).orderBy("vec_id").collect():
        pages.setdefault((r["doc_id"], r["page"]), []).append(r)
    want = {}
    for (doc, page), rows in pages.items():
        kind = lambda b: ("rule" if max(b[2], b[3]) > 0.2 else "tiny") if min(b[2], b[3]) < 0.01 else "page" if b[2] * b[3] > 0.5 else "tiny" if b[2] * b[3] < 0.002 else "figure"
        kept = [b for b in ((r["x"], r["y"], r["w"], r["h"]) for r in rows) if kind(b) in ("figure", "rule")]
        for i, c in enumerate(c for c in folds.cluster_boxes(kept) if c[2] * c[3] <= 0.5):
            mid = c[0] + c[2] / 2, c[1] + c[3] / 2
            want[f"{doc}/{page}", i] = min((math.dist(mid, (r["x"], r["y"])) ** 2, r["vec_id"]) for r in rows)[1]
    got = {(r["place"], r["seq"]): r["cseq"] for r in QUERIES["figure_detect"](spark, sf).collect()}
    assert got == want and got
