"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

The result of a stage is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, langid, near_dedup, packing, secrets
from quern.llm.common import scratch, stable


def _keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose uid (position in the scan) is in found; each uid is there once."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row"))
    return rows.join(found.select("uid"), "uid", "left_semi").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict every text's language; documents without one (null, or no letter) go. lang becomes the prediction."""
    rows = docs.select("doc_id", "text", "lang")
    model = langid.train(rows.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    kind = f"struct<{','.join(f'`{c}`:{t}' for c, t in fields.items())}>"
    found = langid.predict(packed, model, {"row": kind}).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    docs = stable(docs)
    return _keep(docs, exact_dedup.exact_duplicates(docs).where("uid = keep_uid"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays."""
    docs = stable(docs)
    return _keep(docs, near_dedup.near_duplicates(docs).where("kept"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.scrub(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]

#: The stages train, sample and tokenize; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
