"""Subjects, modules and topics: tree, search, counts, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(subjects: DataFrame, modules: DataFrame, topics: DataFrame) -> DataFrame:
    """id, name, modules: array of (id, name, topics: array of (id, name)), each level by name; childless parents have []."""
    empty_t = F.array().cast("array<struct<name:string,id:bigint>>")
    t = topics.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("id").cast("long").alias("id")))).alias("topics"))
    m = modules.join(t, modules["id"] == t["module_id"], "left").select("subject_id", "name", F.col("id").cast("long").alias("id"), F.coalesce("topics", empty_t).alias("topics"))
    m = m.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", "topics"))).alias("modules"))
    empty_m = F.array().cast("array<struct<name:string,id:bigint,topics:array<struct<name:string,id:bigint>>>>")
    return subjects.join(m, subjects["id"] == m["subject_id"], "left").select("id", "name", F.coalesce("modules", empty_m).alias("modules"))


def search(forest: DataFrame, term: str) -> DataFrame:
    """The part of the tree that holds the term: a subject stays with its name or any child, a module with its subject's, its own or a
    topic's name; topics narrow only where some topic holds the term."""
    t = term.strip().lower()
    if not t:
        return forest
    has = lambda c: F.lower(c).contains(t)
    own = has(F.col("name"))

    def narrowed(m):
        hits = F.filter(m["topics"], lambda x: has(x["name"]))
        return F.struct(m["name"].alias("name"), m["id"].alias("id"), F.when(F.size(hits) > 0, hits).otherwise(m["topics"]).alias("topics"))

    kept = F.filter("modules", lambda m: own | has(m["name"]) | F.exists(m["topics"], lambda x: has(x["name"])))
    out = forest.withColumn("kept", F.transform(kept, narrowed))
    return out.filter(own | (F.size("kept") > 0)).select("id", "name", F.col("kept").alias("modules"))


def counts(subjects: DataFrame, modules: DataFrame, topics: DataFrame) -> DataFrame:
    """The numbers of subjects, modules and topics in one row."""
    parts = [d.agg(F.count("*").alias(n)) for d, n in ((subjects, "n_subjects"), (modules, "n_modules"), (topics, "n_topics"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def cascade(subjects: DataFrame, modules: DataFrame, topics: DataFrame, gone: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the subjects ``gone`` and all below them."""
    s = subjects.filter(~F.col("id").isin(gone))
    m = modules.join(s.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return s, m, topics.join(m.select(F.col("id").alias("module_id")), "module_id", "left_semi")
