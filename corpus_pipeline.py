"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept:

1. quality: the classifier learns on the labelled documents of its input and drops the rows it scores under the threshold, each by its own text.
2. near_dedup: documents whose sets of five-word shingles have a similarity of 0.8 or more are near-duplicates (the query op4_near_dedup takes 0.85). Of each group the document with the least doc_id stays, once; rows are told apart by id and text, so another text under an id that goes stays. Rows without an id stay.
3. substring_dedup: words covered by a 13-word window of a document with a smaller id are cut; texts with cuts are what is left, joined by
   spaces, n_chars follows. Texts without cuts stay as they are; a document that is nothing but repeats is dropped.
4. secret_scan: values found to be secrets are replaced in the text, n_chars follows.
5. packing: documents become token sequences of at most 4096; the result has one row per piece.

All but the last return the columns of documents. Null and empty texts, null ids, repeated rows, very long texts, empty tables and tables without a source column pass
through every stage; what the stage does with them its operator's docstring says.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, near_dedup, packing, quality, secrets, substring


def _by_row(docs: DataFrame, kept: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Rows of docs whose (id, text) is (left_semi) or isn't (left_anti) in kept's row_key; once: repeated rows with an id only once."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, near_dedup.row_key("doc_id", "text"))
    if once:
        other = name + "_"
        keyed = keyed.withColumn(other, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates([name, other])
    return keyed.join(kept.select(F.col("row_key").alias(name)), name, how).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = scored.filter(F.col("score") >= quality.THRESHOLD).select("row_key").distinct()
    return _by_row(docs, kept, "left_semi")


#: Similarity of near-duplicates in the corpus, in percent.
NEAR_PERCENT = 80


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("row_key").distinct()
    return _by_row(docs, gone, "left_anti", once=True)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.cut_documents(docs)
    return cut.select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: The learned and iterative stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet to the shared folder and read again; a stage's files go once the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = posixpath.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(base, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            common.remove(spark, before)
        before = path
    return docs
