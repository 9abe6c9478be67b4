"""From raw documents to packed training sequences: five stages, each by one operator of wakeline.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return documents with the columns that came in; the last
returns the pieces of the packed sequences. Between stages the rows are written as Parquet and read again.

Rows whose ids repeat: exact dedup keeps one row of each (id, text); where ids still repeat with different texts, the later stages treat all
rows of an id alike. Rows without an id pass through near dedup unlinked and are mixed like all others.

Null and empty texts: scored like any other, equal to each other in exact dedup, linked with nothing, of size 0 and so never taken by the mixture.
Very long texts are read whole by every stage. Ties: the smaller id stays. An empty table gives an empty table at every stage. Further columns
are kept up to the last stage, whatever their names: the stages' own columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import SPACES, broadcast_if_small, materialize
from wakeline.llm.exact_dedup import exact_dedup
from wakeline.llm.jaccard import jaccard_components
from wakeline.llm.mixing import mix
from wakeline.llm.packing import pack
from wakeline.llm.quality import fit_quality, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit_quality(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    found = materialize(exact_dedup(docs), "pipeline-exact")
    kept = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary"), 256)
    rows = docs.withColumn("__key", sha).join(broadcast_if_small(kept, found.count(), 120), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")), "left_semi")
    if not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__key"])
    return rows.drop("__key")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that Jaccard links of 0.75 or more hold together."""
    found = materialize(jaccard_components(docs), "pipeline-near")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(broadcast_if_small(gone, gone.count(), 24), F.col("doc_id") == F.col("__id"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture to target weights takes of it."""
    taken = mix(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    taken = materialize(taken, "pipeline-mix")
    rows = docs.join(broadcast_if_small(taken, taken.count(), 40), F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixing), ("pack", packing)]

#: SQL can express neither the classifier nor the packing; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
