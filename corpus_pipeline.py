"""A training corpus from raw documents: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.places import scoped
from factgraph.llm import bpe, decontaminate, line_dedup, near_copies, quality
from factgraph.llm.shared import new_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, does not reject.

    Null and empty texts are judged by their zero features, very long ones whole. Rows that repeat an id or a text are
    judged alike, and rows that tie with the cut go or stay together. Without labels, or with labels of one class,
    nothing tells documents apart: all stay, or all go if all labels are bad. All columns stay.
    """
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.learn(docs, labels, F.lit(True)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text.

    A null text becomes empty. Rows that share an id are one document, a row with a null id loses nothing; a document
    that loses all its lines stays with an empty text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = line_dedup.dedup_lines(docs, carry=others)
    named = {"doc_id": F.col("id"), "text": F.col("kept")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    if "n_chars" in named:
        named["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*(named[c].alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    The Gray-order index over SimHash fingerprints links what lies within 2 bits, MinHash bands the rest; all links are
    checked exactly. The row with the smallest id stays, all rows of that id where it repeats, and every row with a null id. Texts
    without words are copies of each other, null ones too. Very long texts are shingled whole. All columns stay.
    """
    return near_copies.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none, an empty benchmark has none.

    Very long texts are searched whole. Rows with null ids are judged by their text like all others, repeated rows
    stay or go together. All columns stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with digests of the ids and of the decoded text; an empty or null text has no ids.

    Very long texts are encoded whole. Every row gives one row, repeated or with a null id too. This is the last stage:
    of the columns of documents only doc_id is left, lang, source and text are no part of what it returns.
    """
    return bpe.round_trip(docs, bpe.default_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]
#: The classifier and the matching within an edit budget have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = new_path(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        with scoped(spark):  # what a stage writes for itself goes once its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
