"""Named Parquet tables of one data folder, and the bank of items over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; a file or a folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a bank of items: seq, id, subject, paper_name, question_number, marks, content, module, topics, the two flags.

    ``seq`` stands for the storage order. Numbers, modules and topics follow from the id by rule, so that the SQL of a query
    can state them too; some numbers are null and some modules missing, 'Unknown' or 'General'.
    """
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return docs.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left").select(
        d.alias("seq"),
        F.concat(F.lit("d"), d.cast("string")).alias("id"),
        F.col("lang").alias("subject"),
        F.col("source").alias("paper_name"),
        F.when(d % 11 != 0, d % 40).alias("question_number"),
        (d % 9).alias("marks"),
        F.col("text").alias("content"),
        F.when(d % 5 == 0, "Unknown").when(d % 5 == 1, "General").when(d % 5 > 2, F.concat(F.lit("m"), (d % 7).cast("string"))).alias("module"),
        F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (d % 6).cast("string")), F.concat(F.lit("u"), (d % 4).cast("string")))).alias("topics"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_review"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("answer_stale"),
    )


#: The same bank for DuckDB.
ITEMS_SQL = """items AS (SELECT d.doc_id AS seq, 'd' || d.doc_id AS id, lang AS subject, source AS paper_name,
  CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 40 END AS question_number, d.doc_id % 9 AS marks, text AS content,
  CASE WHEN d.doc_id % 5 = 0 THEN 'Unknown' WHEN d.doc_id % 5 = 1 THEN 'General' WHEN d.doc_id % 5 > 2 THEN 'm' || (d.doc_id % 7) END AS module,
  CASE WHEN d.doc_id % 3 = 0 THEN []::VARCHAR[] ELSE ['t' || (d.doc_id % 6), 'u' || (d.doc_id % 4)] END AS topics,
  coalesce(quality = 0, false) AS needs_review, coalesce(toxic = 1, false) AS answer_stale
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""
