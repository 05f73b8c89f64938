"""Corpus pipeline: documents to packed training windows in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from terralit.llm.common import sweep, table, written
from terralit.llm.linededup import line_dedup
from terralit.llm.ngram_join import near_dedup
from terralit.llm.packing import pack
from terralit.llm.pii import personal_data
from terralit.llm.quality import classify


def _on(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage applied to docs: its columns come back in their order and types, whatever their names, with n_chars (if
    there) counted again.  The stage sees doc_id and text under their names and the others under names
    that no operator uses."""
    seen = {c: c if c in ("doc_id", "text") else f"__of_documents_{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(new) for c, new in seen.items()]))
    return out.select(*[(F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(new)).alias(c) for c, new in seen.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier keeps.  Null texts go; empty ones are judged like any
    other; repeated rows are judged alike; without labels to learn from all texts stay."""
    return _on(docs, lambda d: classify(d, table(spark, sf_dir, "labels")).filter("keep"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents of which nothing is left go.  Null texts and texts
    that were empty before stay; of repeated rows of enough words one stays."""
    return _on(docs, lambda d: line_dedup(d).filter("lines_removed = 0 or trim(text) <> ''"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.  Null ids, null texts and texts
    without a word are in no group and stay; of repeated rows one stays."""
    return _on(docs, near_dedup)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind.  No row goes; null and empty texts stay as they are."""
    return _on(docs, personal_data)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens.  Null and blank texts have no piece; null ids and repeated
    rows are packed each."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: The classifier and the tagger are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again for the next; what a stage
    needed besides is deleted from there once it is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            sweep(docs)
    return docs
