"""The feed: search, facets, totals and pages over the bank of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared import fresh_folder

#: Modules that say nothing.
NO_MODULE = ("Unknown", "General")
#: Items shown at first and after a while.
FIRST_PAGE, NEXT_PAGE = 12, 60


def defaults(items: DataFrame, values: dict) -> DataFrame:
    """Nulls of the named columns replaced."""
    return items.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``rows`` with their place in the order, from 1, without bringing them to one task.

    Range partitions are sorted and written to the shared folder, which fixes them; a place is a row's number in its partition
    after the rows of the partitions before. Only one row for each partition is gathered.
    """
    spark = rows.sparkSession
    at = fresh_folder(spark, "numbered")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    ranged.write.parquet(at)
    kept = spark.read.schema(ranged.schema).parquet(at)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    return kept.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_row", "_before")


def newest_first(items: DataFrame, seq: str = "seq") -> DataFrame:
    """``items`` with ``position``, 1 for the newest."""
    return numbered(items, F.col(seq).desc())


def corpus(*cols: str) -> Column:
    """The lower-case text that search looks in: the columns joined by spaces, null as empty."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


def search(items: DataFrame, term: str, *cols: str) -> DataFrame:
    """Items whose corpus holds the trimmed, lower-case term; all for an empty one."""
    term = term.strip().lower()
    return items.filter(corpus(*cols).contains(term)) if term else items


def resolve(items: DataFrame, subjects: DataFrame, col: str, into: str) -> DataFrame:
    """``col`` resolved to a subject's name by id or by name in any case (the first subject by id wins), else as it is."""
    s = subjects.select(F.col("id").cast("string").alias("s_id"), F.col("name").alias("s_name"))
    keys = s.select(F.col("s_id").alias("key"), "s_id", "s_name").unionByName(s.select(F.lower("s_name").alias("key"), "s_id", "s_name"))
    first = keys.groupBy("key").agg(F.min_by("s_name", "s_id").alias("s_name"))
    by_id, by_name = first.withColumnRenamed("s_name", "n1"), first.withColumnRenamed("s_name", "n2").withColumnRenamed("key", "key2")
    out = items.join(by_id, F.col(col).cast("string") == F.col("key"), "left").join(by_name, F.lower(F.col(col).cast("string")) == F.col("key2"), "left")
    return out.withColumn(into, F.coalesce("n1", "n2", F.col(col).cast("string"))).drop("key", "key2", "n1", "n2")


def same_text(col: Column, value: str) -> Column:
    return F.lower(F.trim(col)) == value.strip().lower()


def marks_band(marks: Column) -> Column:
    """'1-2', '3-5', '6+', or null for no band."""
    return F.when(marks.between(1, 2), "1-2").when(marks.between(3, 5), "3-5").when(marks >= 6, "6+")


def any_topic(topics: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(topics, F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))


def in_module(module: Column, topics: Column, wanted: str, topics_of_module: list[str], topic_filter: bool = False) -> Column:
    """Equality where the module says something; else the topics decide, unless a topic filter is on or there are none: pass."""
    says = module.isNotNull() & ~module.isin(*NO_MODULE) & (module != "")
    by_topics = (F.lit(not topic_filter)) & (F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0)
    return F.when(says, module == wanted).when(by_topics, any_topic(topics, topics_of_module)).otherwise(F.lit(True))


def review_state(needs_review: Column, stale: Column, wanted: str) -> Column:
    either = F.coalesce(needs_review, F.lit(False)) | F.coalesce(stale, F.lit(False))
    return either if wanted == "Needs review" else ~either if wanted == "Clean" else F.lit(True)


def contained(topics: Column, allowed: list[str]) -> Column:
    """The topics that are allowed (all, if none are named), sorted, each once."""
    kept = F.array_intersect(topics, F.array(*map(F.lit, allowed))) if allowed else topics
    return F.array_sort(F.array_distinct(kept))


def append_new(chosen: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """An ordered list (key, pos) with the keys of another that it lacks appended in their order."""
    last = chosen.agg(F.max("pos")).first()[0] or 0
    new = added.join(chosen.select(key), key, "left_anti").groupBy(key).agg(F.min("pos").alias("_pos"))
    placed = numbered(new, F.col("_pos"), F.col(key), name="pos")
    return chosen.select(key, F.col("pos").cast("long")).unionByName(placed.select(key, (F.col("pos") + last).cast("long").alias("pos")))


def ordered_lookup(items: DataFrame, ids: list, key: str) -> DataFrame:
    """The items of ``ids`` in the caller's order with ``pos``; unknown ids are left out."""
    wanted = items.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "wanted"))
    return items.join(F.broadcast(wanted), F.col(key) == F.col("wanted")).drop("wanted")


def worksheet_totals(rows: DataFrame, marks: str, target: int) -> DataFrame:
    """Total marks, minutes at 1.2 a mark, and progress to the target in percent, 100 at most."""
    total = F.coalesce(F.sum(marks), F.lit(0))
    return rows.agg(total.cast("long").alias("total_marks"), F.round(total * 1.2).cast("long").alias("minutes"), F.least(F.round(total * 100.0 / (target or 1)), F.lit(100)).cast("long").alias("progress"))
