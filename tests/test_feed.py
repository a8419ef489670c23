from pyspark.sql import functions as F

from docloom.operators import feed


def test_numbered_is_distributed(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5003).alias("v"))
    got = feed.numbered(rows, F.col("v").desc()).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["position"])] == sorted((i * 37 % 5003 for i in range(5000)), reverse=True)
    assert sorted(r["position"] for r in got) == list(range(1, 5001))
    assert feed.numbered(rows.limit(0), F.col("v")).count() == 0


def test_append_keeps_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, pos long")
    b = spark.createDataFrame([("z", 1), ("y", 2), ("w", 3)], "id string, pos long")
    assert sorted((r["pos"], r["id"]) for r in feed.append_new(a, b).collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def test_module_and_review(spark):
    rows = spark.createDataFrame([("m", [], True, None), (None, ["t"], False, False), ("Unknown", ["u"], None, None), ("n", ["t"], None, True)], "module string, topics array<string>, r boolean, s boolean")
    keep = [r[0] for r in rows.select(feed.in_module(F.col("module"), F.col("topics"), "m", ["t"])).collect()]
    assert keep == [True, True, False, False]
    assert [r[0] for r in rows.select(feed.review_state(F.col("r"), F.col("s"), "Needs review")).collect()] == [True, False, False, True]
