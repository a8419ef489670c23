"""Files in and out: whole texts, flash cards, worksheets, backups, a cache by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_VERSION = "2"
BACKUP_VERSION = 1
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def collapse_newlines(text: Column) -> Column:
    """Lines trimmed, three line breaks and more made two, ends trimmed."""
    lines = F.regexp_replace(text, r"[ \t\f\x0b\r]*\n[ \t\f\x0b\r]*", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_page(text: Column) -> Column:
    """Page text without runs of '_' or '-', lines of a lone digit 1 to 6, and with '0 7 . 2' joined to '07.2'."""
    t = F.regexp_replace(text, r"[_-]{3,}", "")
    t = F.regexp_replace(t, r"(?md)^[ \t]*[1-6][ \t]*$\n?", "")
    return F.regexp_replace(t, r"(?md)^0 ([0-9])[ \t]*\.[ \t]*([0-9])", "0$1.$2")


def content_key(*parts: Column) -> Column:
    """Sixteen hexadecimal digits that name a content, with the cache's version."""
    return F.substring(F.sha2(F.concat_ws("|", *parts, F.lit(CACHE_VERSION)), 256), 1, 16)


def read_flashcards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a file without header, tabs in .txt and .tsv, commas else: front, back, tags; rows without a front are skipped."""
    sep = "\t" if path.lower().endswith((".txt", ".tsv")) else ","
    raw = spark.read.csv(path, sep=sep, header=False, quote='"', escape='"', mode="DROPMALFORMED", schema="front string, back string, tags string")
    tags = F.filter(F.split(F.trim(F.coalesce("tags", F.lit(""))), r"\s+"), lambda x: x != "")
    return raw.filter(F.trim(F.coalesce("front", F.lit(""))) != "").select("front", F.coalesce("back", F.lit("")).alias("back"), F.when(F.size(tags) > 0, tags).alias("topics"), F.lit("Imported").alias("subject"), F.lit("General").alias("subtopic"), F.lit(1).alias("marks"), F.lit("Imported File").alias("paper_name"))


def flashcards(items: DataFrame) -> DataFrame:
    """front, back, tags of items: tags are subject, a module that says something, and the topics."""
    module = F.when(F.col("module").isNotNull() & ~F.col("module").isin("Unknown", "General"), F.col("module"))
    return items.select("content", "answer", F.concat_ws(" ", F.col("subject"), module, F.array_join("topics", " ")).alias("tags")).select(F.col("content").alias("front"), F.coalesce("answer", F.lit("")).alias("back"), F.trim("tags").alias("tags"))


def write_flashcards(items: DataFrame, path: str) -> None:
    flashcards(items).write.csv(path, sep=",", quote='"', escape='"')


def safe_name(name: Column) -> Column:
    """Letters, digits, '-', '_' and spaces stay, others become '_'; trimmed, spaces to '_'."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")), " ", "_")


def worksheet(rows: DataFrame, group: str, pos: str, content: str, marks: str) -> DataFrame:
    """A Markdown worksheet for each group: numbered questions in order, the total and the minutes."""
    each = F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(content).alias("content"), F.col(marks).alias("marks")))
    out = rows.groupBy(group).agg(F.array_sort(each).alias("q"), F.sum(marks).alias("total"))
    body = F.array_join(F.transform("q", lambda x, i: F.concat(F.lit("## Question "), (i + 1).cast("string"), F.lit(" ["), x["marks"].cast("string"), F.lit(" marks]\n\n"), x["content"])), "\n\n")
    return out.select(group, F.concat(F.lit("Total: "), F.col("total").cast("string"), F.lit(" marks, "), F.round(F.col("total") * 1.2).cast("long").cast("string"), F.lit(" minutes\n\n"), body).alias("sheet"))


def continuation_pages(marks: Column, lined: Column) -> Column:
    """Extra pages of a question on a lined sheet: 2 from 11 marks, 1 from 5."""
    return F.when(lined & (marks >= 11), 2).when(lined & (marks >= 5), 1).otherwise(0)


def image_refs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Each image of the texts once: ref and the name it gets in a backup; files of one name get their rank before it."""
    refs = rows.select(F.explode(F.regexp_extract_all(text, F.lit(IMAGE), 1)).alias("ref")).distinct()
    base = F.regexp_extract("ref", r"([^/\\]+)$", 1)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("base").orderBy("ref"))
    return refs.withColumn("base", base).withColumn("n", n).select("ref", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat((F.col("n") - 1).cast("string"), F.lit("-"), F.col("base"))).alias("name"))


def write_backup(items: DataFrame, path: str, created: int) -> None:
    """A backup folder: manifest and items as JSON lines; each is replaced whole."""
    items.write.mode("overwrite").json(f"{path}/items")
    items.agg(F.lit(BACKUP_VERSION).alias("formatVersion"), F.lit(created).cast("long").alias("created_at"), F.count("*").alias("n_items")).write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a backup; a newer format is refused before anything else is read."""
    m = spark.read.json(f"{path}/manifest").first().asDict()
    if m["formatVersion"] > BACKUP_VERSION:
        raise ValueError(f"backup format {m['formatVersion']} is newer than {BACKUP_VERSION}")
    return m


def read_backup(spark: SparkSession, path: str, schema) -> DataFrame:
    read_manifest(spark, path)
    return spark.read.schema(schema).json(f"{path}/items")


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The Parquet table of a fingerprint, made on first use."""
    path = f"{folder}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
