"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet before the next stage reads
it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import decontaminate, packing, quality, resemblance, secrets
from conceptflow.session import shelve, table


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the upper grade is one half or more; the others go."""
    return quality.accepted(docs, quality.fitted(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (Jaccard of five-word shingles 0.8 or more): that of the smallest doc_id; rows without id stay.

    Candidates come from SimHash fingerprints and, beyond their radius, from MinHash bands; each link is checked on whole texts.
    Rows of one doc_id with different texts are documents of their own: each
    stands or falls with its group. Of equal rows one stays.
    """
    groups = resemblance.near_copies(docs).where("doc_id is not null")
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept_"))
    mark = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
    named = docs.where("doc_id is not null").withColumn("kept_", mark).join(kept.select("kept_"), "kept_", "left_semi").dropDuplicates(["kept_"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; the others go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def unsecret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret is replaced by a mark, and n_chars follows the text."""
    found, _ = secrets.scan(docs)
    spans = F.col(found.columns[-1])
    clean = found.withColumn("text", secrets.redacted(F.col("text"), spans))
    changed = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", rated),
    ("near-duplicate removal", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret removal", unsecret),
    ("best-fit packing", packed),
]
#: Fitted models, fingerprints and tokenizers can't be expressed in SQL; tests/llm checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shelve(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
