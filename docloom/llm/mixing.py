"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Sources get targets by water filling; the documents of each source are dealt into hash blocks;
each pass over a source draws its blocks in a random order without replacement, so a draw is disjoint within its pass; a
binary tree splits the vector of block quotas among output shards, each split one multivariate-hypergeometric draw; within
a shard the documents are ordered at random. All randomness is a hash of a seed and a key, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import forget, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, and times that a document may occur.
SHARE, MOST = 1.5, 2
#: Words of a block on average, blocks of a source at most (beyond that blocks are larger), and levels of the splitting tree.
BLOCK_WORDS, MOST_BLOCKS, LEVELS = 65536, 1 << 20, 4


def unit(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key's parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def named(source) -> Column:
    """A source's name as a string that no other source and not the null one has."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, ``t`` (the text's hash), size in words (null text: 0) and the row's random key ``u``; repeated rows share a
    key and a fate."""
    return docs.select(
        "doc_id", "source", F.xxhash64("text").alias("t"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), unit(F.lit("d"), F.col("doc_id").cast("string")).alias("u")
    )


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: water filling under the cap ``most`` times the source's size.

    One row for each source, so the two unpartitioned windows see as many rows as there are sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(most * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("free", F.col("weight") * F.col("level") <= cap)
    level = F.min(F.when(F.col("free"), F.struct(cap / F.col("weight"), F.col("level")))).over(every)["level"]
    capped = ~F.coalesce(F.col("weight") * level <= cap, F.lit(False))
    return per.select("source", "source_size", "weight", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def draws(sizes: DataFrame, targets: DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The document rows with ``copies``, the block and its place (rank in a pass) in their source.

    Whole passes take every block. The last, partial pass takes blocks in random order while they fit the words that
    remain, then documents of the next block while they fit, then the one untaken document of that block that fills the
    gap best. Rounding is below half of that block's smallest document that helps.
    """
    t = targets.select(
        F.col("source").alias("t_source"),
        "source_size",
        F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("long").alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
        "target",
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    d = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).drop("t_source").withColumn("block", F.least(F.floor(F.col("u") * F.col("n_blocks")), F.col("n_blocks") - 1))
    blocks = d.groupBy("source", "block", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(unit(F.lit("b"), named(F.col("source")), F.col("block").cast("string")), "block")
    blocks = blocks.withColumns({"place": F.row_number().over(order), "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = blocks.select("source", F.col("block").alias("b_block"), "place", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("room"), "words")
    d = d.join(blocks.withColumnRenamed("source", "b_source"), d["source"].eqNullSafe(F.col("b_source")) & (d["block"] == F.col("b_block"))).drop("b_source", "b_block")
    # the boundary block of a source: the first whose words exceed the room
    edge = d.filter((F.col("room") > 0) & (F.col("words") > F.col("room")) & (F.col("size") > 0))
    inside = Window.partitionBy("source").orderBy(unit(F.lit("e"), F.col("doc_id").cast("string")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("cum", F.sum("size").over(inside))
    gap = Window.partitionBy("source")
    edge = edge.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("cum") <= F.col("room"), F.col("cum"))).over(gap), F.lit(0)))
    best = F.min(F.when((F.col("cum") > F.col("room")) & (F.col("size") <= 2 * F.col("gap")), F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), F.col("doc_id")))).over(gap)
    taken = edge.withColumn("best", best["doc_id"]).filter((F.col("cum") <= F.col("room")) | ((F.col("cum") > F.col("room")) & (F.col("doc_id") == F.col("best"))))
    taken = taken.groupBy(F.col("doc_id").alias("e_id"), F.col("source").alias("e_source"), F.col("size").alias("e_size")).agg(F.count("*").alias("e_rows"))
    d = d.join(taken, (d["doc_id"].eqNullSafe(F.col("e_id"))) & d["source"].eqNullSafe(F.col("e_source")) & (d["size"] == F.col("e_size")), "left")
    partial = ((F.col("room") > 0) & (F.col("words") <= F.col("room"))) | F.col("e_id").isNotNull()
    return d.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(partial & (F.col("whole") < most), 1).otherwise(0)).otherwise(0)).drop("e_id", "e_source", "e_size", "e_rows")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``total``, of which ``good`` are good, are good: inversion at ``u``, outward from the mode.

    The probabilities are scaled so that the mode has weight 1; both sums run over the range within ten deviations.
    """

    def up(s, k, p):
        return s["w"] * (p["good"] - k + 1) * (p["drawn"] - k + 1) / (k * (p["total"] - p["good"] - p["drawn"] + k))

    def down(s, k, p):
        return s["w"] * ((k + 1) * (p["total"] - p["good"] - p["drawn"] + k + 1)) / ((p["good"] - k) * (p["drawn"] - k))

    def summed(ks, p, step):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(ks, start, lambda s, k: _let(step(s, k, p), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))["sum"]

    def seek(ks, p, step, begun, at):
        start = F.struct(F.lit(1.0).alias("w"), begun.alias("sum"), F.lit(None).cast("bigint").alias("k"))

        def go(s, k):
            return _let(step(s, k, p), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.coalesce(s["k"], F.when(s["sum"] + w > at, k)).alias("k")))

        return F.aggregate(ks, start, go)["k"]

    def ranged(p):
        none = F.array().cast("array<bigint>")
        ups = F.when(p["high"] > p["mode"], F.sequence(p["mode"] + 1, p["high"])).otherwise(none)
        downs = F.when(p["mode"] > p["low"], F.sequence(p["mode"] - 1, p["low"], F.lit(-1).cast("long"))).otherwise(none)
        return _let(F.struct(summed(ups, p, up).alias("above"), summed(downs, p, down).alias("below")), lambda m: _let(u * (1.0 + m["above"] + m["below"]), lambda at: F.when(at < 1.0, p["mode"]).otherwise(F.coalesce(seek(ups, p, up, F.lit(1.0), at), seek(downs, p, down, 1.0 + m["above"], at), p["mode"]))))

    low, high = F.greatest(F.lit(0), drawn - (total - good)), F.least(drawn, good)
    spread = F.ceil(10 * F.sqrt(drawn * good / F.greatest(total, F.lit(1)))) + 10
    mode = F.least(F.greatest(F.floor((drawn + 1) * (good + 1) / (total + 2)), low), high)
    first = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), low.alias("low"), high.alias("high"), mode.cast("long").alias("mode"), spread.alias("spread"))
    return _let(first, lambda p: _let(F.struct(p["total"].alias("total"), p["good"].alias("good"), p["drawn"].alias("drawn"), p["mode"].alias("mode"), F.greatest(p["low"], p["mode"] - p["spread"]).cast("long").alias("low"), F.least(p["high"], p["mode"] + p["spread"]).cast("long").alias("high")), ranged))


def shard_quotas(quotas: DataFrame, levels: int = LEVELS, seed: str = "t") -> DataFrame:
    """Split ``source, quota`` (whole blocks) among ``2**levels`` shards: shard, source, lo, hi (the source's draws lo < n <= hi).

    Each tree node halves its blocks: the left child's vector is one multivariate-hypergeometric draw, a chain of
    univariate draws over the sources, so every split is exact and quotas sum up at each level.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(named(F.col("source")).alias("s"), F.col("quota").cast("long").alias("q")))).alias("v")).withColumn("node", F.lit("1"))
    for _ in range(levels):
        total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        side = unit(F.lit(seed), F.col("node"), F.lit("half")) < 0.5
        half = F.floor(total / 2) + F.when(side, total % 2).otherwise(0)
        none = F.array().cast("array<struct<s:string,q:bigint>>")
        node = node.withColumns({"total": total, "half": half.cast("long")})

        def draw(acc, x):
            drawn = _hypergeometric(acc["total"], x["q"], acc["left"], unit(F.lit(seed), acc["node"], x["s"]))
            return _let(drawn, lambda k: F.struct((acc["total"] - x["q"]).alias("total"), (acc["left"] - k).alias("left"), acc["node"].alias("node"), F.concat(acc["v"], F.array(F.struct(x["s"].alias("s"), k.alias("q")))).alias("v")))

        begin = F.struct(F.col("total").alias("total"), F.col("half").alias("left"), F.col("node").alias("node"), none.alias("v"))
        node = node.withColumn("l", F.aggregate("v", begin, draw)["v"])
        right = F.zip_with("v", "l", lambda a, b: F.struct(a["s"].alias("s"), (a["q"] - b["q"]).alias("q")))
        kids = F.array(F.struct(F.concat("node", F.lit("0")).alias("node"), F.col("l").alias("v")), F.struct(F.concat("node", F.lit("1")).alias("node"), right.alias("v")))
        node = node.select(F.explode(kids).alias("c")).select("c.node", "c.v")
    leaves = node.select((F.conv(F.substring("node", 2, 64), 2, 10).cast("long") if levels else F.lit(0).cast("long")).alias("shard"), F.explode("v").alias("x")).select("shard", "x.s", "x.q")
    upto = F.sum("q").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return leaves.select("shard", F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("source"), (upto - F.col("q")).alias("lo"), upto.alias("hi")).filter("hi > lo")


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source): (plan, placed).

    ``plan`` has a row for each document row: doc_id, source, t (the text's hash), size, source_size, target, copies (0 to ``most``).
    ``placed`` has a row for each copy: doc_id, source, t, pass, shard, key; sorted by key within a shard it is shuffled.

    Null texts and texts without words have size 0, are never taken and change no total; a null source is a source of its
    own, last in order. Repeated rows are separate documents with the same key. An empty table gives empty results. Extra
    columns are ignored.
    """
    sizes = written(sized(docs), "mix-sizes")
    # written, so that its size is known where the joins on the source choose whether to broadcast it
    targets = written(source_targets(sizes, share, most, weights), "mix-targets")
    plan = written(draws(sizes, targets, most, block_words), "mix-plan")
    forget(sizes)
    copies = plan.filter("copies > 0").select("doc_id", "source", "t", "block", "place", "n_blocks", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("pass"))
    # draws of a source: its blocks in the order of the pass, one pass after the other
    n = (F.col("pass") - 1) * F.col("n_blocks") + F.col("place")
    quotas = plan.filter("copies > 0").groupBy("source").agg(F.max((F.col("copies") - 1) * F.col("n_blocks") + F.col("place")).alias("quota"))
    shards = shard_quotas(quotas, levels).withColumnRenamed("source", "q_source")
    placed = copies.withColumn("n", n).join(shards, copies["source"].eqNullSafe(F.col("q_source")) & (F.col("n") > F.col("lo")) & (F.col("n") <= F.col("hi")))
    return plan, placed.select("doc_id", "source", "t", "pass", "shard", F.xxhash64(F.lit("k"), "doc_id", "pass").alias("key"))
