"""Training corpus from raw documents: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written before the next stage
reads it. All but the last return the columns of ``documents``. The session's Arrow batches are held
to about 2 MB from the first stage on, since a stage's table is computed when its caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, packing, quality, secrets
from corpusloom.llm._store import BATCH_BYTES, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among all documents, rejects neither for low quality nor as toxic."""
    spark.conf.set(*BATCH_BYTES)
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.train(labelled, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score_quality(docs.select(*COLUMNS), model).where("kept and coalesce(clean, true)").select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    return exact_dedup.exact_dedup(docs, carry=COLUMNS).select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, where null is the largest."""
    numbered = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    stay = jaccard_join.near_duplicates(numbered, row_col="row").where("stays").select("row")
    return numbered.join(stay, "row", "left_semi").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by a mark."""
    return secrets.redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    spark.conf.set(*BATCH_BYTES)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("secret scans", secret_scans),
    ("packing", packing_stage),
]

#: A fitted classifier and a tokenizer are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
