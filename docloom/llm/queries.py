"""The operators' registered queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import load


def op3_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.bwt_dedup import remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import mix

    plan, placed = mix(load(spark, sf_dir, "documents"))
    key = ("doc_id", "source", "t")
    once = placed.select(*(F.col(c).alias(f"s_{c}") for c in key), "pass", "shard").distinct()
    shards = once.groupBy(*(f"s_{c}" for c in key)).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    same = [plan[c].eqNullSafe(shards[f"s_{c}"]) for c in key]
    rows = plan.join(shards.hint("shuffle_hash"), same, "left")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.col("copies")).alias("taken"), "shards")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.html_tree import main_texts

    return main_texts(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.token_store import token_output

    return token_output(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_media_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.media_tar import media_columns

    cols = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    return media_columns(load(spark, sf_dir, "documents")).select(*cols)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontaminate import leaks

    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity import REJECT, fit, labelled, toxicity

    docs = load(spark, sf_dir, "documents")
    rows = toxicity(docs.select("doc_id", "text"), fit(labelled(docs, load(spark, sf_dir, "labels"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.ngram_join import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.token_count import token_counts

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.langid import Model, identify, labelled

    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, Model(labelled(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


#: All windows of 400 bytes of all texts, by their hexadecimal form.
OP3_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
  w AS (SELECT r, unnest(range(strlen(x) // 2 - 399)) AS i, x FROM d WHERE strlen(x) >= 800),
  h AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM w),
  g AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
  b AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS n FROM g),
  k AS (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS k FROM b),
  s AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM k GROUP BY r, k),
  e AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p, lead(a) OVER (PARTITION BY r ORDER BY a) AS q FROM s),
  t AS (SELECT e.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || any_value(CASE WHEN q IS NULL THEN substr(x, 2 * z + 1) END) AS kept FROM e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""

#: All pairs of different 5-gram sets that share a gram, and the transitive closure of the links.
OP8_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\v\f\r \x{85}\x{A0}\x{2028}\x{2029}]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, unnest([list_aggregate(w[i:i + 4], 'string_agg', ' ') FOR i IN range(1, greatest(2, len(w) - 3))]) AS g FROM w WHERE len(w) > 0),
  sets AS (SELECT doc_id, md5(string_agg(md5(g), '' ORDER BY g)) AS s, count(*) AS n FROM g GROUP BY doc_id),
  texts AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY s),
  c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT rep FROM texts) AND b.doc_id IN (SELECT rep FROM texts) GROUP BY 1, 2),
  p AS (SELECT u, v FROM c JOIN texts x ON x.rep = u JOIN texts y ON y.rep = v WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
  both_ AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
  reach AS (SELECT rep AS u, rep AS v FROM texts UNION SELECT r.u, b.v FROM reach r JOIN both_ b ON b.u = r.v),
  roots AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u), deg AS (SELECT u, count(*) AS k FROM both_ GROUP BY u)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(rep, d.doc_id) AS text_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN texts ON texts.s = sets.s LEFT JOIN roots ON roots.u = rep LEFT JOIN deg ON deg.u = rep"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against brute force, round trips and held-out rows in tests."""
    return {"op3_bwt_dedup": OP3_SQL, "op8_ngram_join": OP8_SQL}
