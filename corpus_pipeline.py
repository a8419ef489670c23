"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes the documents that its predecessor kept, in the columns of ``documents``; ``run`` writes each stage's result as
Parquet in the shared folder and rereads it. The last stage returns the token store's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontaminate, mixing, ngram_join, token_store, toxicity
from docloom.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold; the scorer learns from labels outside the held-out fold."""
    scorer = toxicity.fit(toxicity.labelled(docs, load(spark, sf_dir, "labels")))
    # the score joins the columns under a name that none of them has
    held = docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns if c != "text"})
    kept = toxicity.toxicity(held, scorer).filter(F.col("score") < toxicity.REJECT)
    return kept.select(*(F.col("text" if c == "text" else f"d_{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of benchmark items."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard after shard, shuffled within each; a document that the mix takes twice is there twice."""
    _, placed = mixing.mix(docs)
    key = {"m_id": "doc_id", "m_source": "source", "m_t": "t", "m_shard": "shard", "m_key": "key"}
    once = placed.dropDuplicates(["doc_id", "source", "t", "pass"]).select(*(F.col(c).alias(m) for m, c in key.items()))
    mixed = docs.join(once, docs["doc_id"].eqNullSafe(F.col("m_id")) & docs["source"].eqNullSafe(F.col("m_source")) & (F.xxhash64(docs["text"]) == F.col("m_t")))
    return mixed.repartitionByRange(common.shuffle_partitions(spark), once["m_shard"], once["m_key"]).sortWithinPartitions(once["m_shard"], once["m_key"]).select(*(docs[c] for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_store.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: No SQL expresses the scorer, the band hashes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' work on ``documents``; tables that a stage made on its way, and its predecessor's result, go once it is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.temporary(spark):
            out = stage(spark, docs, sf_dir)
            path = common.fresh(spark, f"stage-{name}")
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.discard(spark, before)
        before = path
    return docs
