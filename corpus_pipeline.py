"""From raw documents to packed token windows, in stages.

Each stage takes the documents the stage before it kept, as a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import mixing, packing, parityjoin, pii, preference
from recordloom.llm.shared import fresh, staged, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the preference classifier does not reject.

    It learns from the labels of the stage's own documents.
    """
    labels = preference.training_labels(table(spark, folder, "labels"))
    model, share = preference.train(docs, F.col("doc_id"), F.col("text"), labels)
    return docs.where(preference.scored(docs, F.col("text"), model, share) >= preference.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words are in no group and stay. A document whose whole
    row is repeated stays once for each repetition of an id that stays.
    """
    groups = parityjoin.near_duplicates(docs, F.col("doc_id"), F.col("text"))
    gone = fresh("gone")
    copies = groups.where("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, docs["doc_id"] == copies[gone], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the new text."""
    out = pii.mask(docs, "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.emit(mixing.systematic_mix(docs, F.col("text"), F.col("source"), F.col("doc_id")))


def packed_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    return packing.pack(docs, F.col("doc_id"), F.col("text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed_windows", packed_windows),
]

# Learned scores, sketches and token ids are beyond SQL; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return staged(stage(spark, docs, sf_dir), f"stage-{name}")
