"""Corpus pipeline: quality filter, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir), works on everything the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet into the shared
folder and reads them back for the next; a stage's rows are deleted when the
next stage's are written, and what it wrote on its way when its rows are.

Every stage takes null and empty texts as texts without words, treats rows
that repeat a doc_id and rows without one as its operator says, carries extra
columns of any name along (the last returns its own), and gives an empty
result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, packing, quality, simhash, suffix


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a bounded sample of their labels, doesn't reject."""
    score = quality.scorer(quality.fit_on(docs, common.table(spark, sf_dir, "labels")))
    return docs.where(score(common.text_bytes()) >= quality.THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more; rows without a doc_id stay."""
    return simhash.keep_one(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 50-byte strings of earlier documents; n_chars follows the text."""
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand: one row for each piece of a document in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_passage_stage),
    ("best-fit packing", packing_stage),
]

#: No stage can be expressed in SQL (a boosted model, fingerprints with components, an ordered greedy packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        made = common.paths_made()
        docs, path = common.materialize_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.tidy(spark, path, made)
        if before is not None:
            common.remove(spark, before)
        before = path
    return docs
