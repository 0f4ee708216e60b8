"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, near_dup, pieces, quality, store

#: A language is accepted if it is at least as likely as this.
LEAST_LIKELY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is predicted to be 1."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = store.unused(docs, "score")
    return quality.score_documents(docs, model, out=score).where(F.col(score) >= 0.5).drop(score)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is clear."""
    lang, score = store.unused(docs, "predicted"), store.unused(docs, "score")
    found = langid.identify(docs, langid.fit(docs), lang=lang, score=score)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LIKELY)).drop(lang, score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, similarity 0.8."""
    return near_dup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, with the scores of the best segmentations and the check that they decode to the text."""
    return pieces.encode_documents(docs, with_ids=True).drop("text")


STAGES = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_identified),
    ("minhash_near_dedup", keep_distinct),
    ("benchmark_decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: Learned models decide in the first two stages, so SQL can't express the result; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote goes when the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.scratch(spark, f"pipeline-{name}")
        docs = store.materialize(stage(spark, docs, sf_dir), path)
        if before:
            store.FileStore(spark, before).delete(before)
        before = path
    return docs
