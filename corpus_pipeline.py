"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of
documents.  Stages are written as Parquet and read again.

For every stage: other columns, whatever their names, are carried along (the last stage doesn't read them); an empty table gives no
rows; texts are read whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm import decontam, mixing, neardup, packing, quality
from sparrowmill.llm.common import Scratch, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep; the trees are fitted on labelled rows of what comes in.

    Null, empty and short texts go; a row without an id is judged by its text; repeated rows are judged alike; a score of exactly the
    threshold stays; without labels of both classes only the rules judge."""
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), whole_rows=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): that with the smallest id.

    Null and empty texts are linked with nothing and stay, as do rows without an id.  Of rows with equal ids and texts one stays, that
    with the smallest digest of all columns; rows with equal ids and other texts are judged each by its own."""
    return neardup.representatives(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; null and empty items match nothing; rows without an id and repeated rows are judged by
    their texts; a text with exactly the budget of edits goes."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null and empty texts have no words and come as often as their source's whole rate.  Repeated
    rows and rows without an id are rounded each on its own."""
    return mixing.mixed(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids, read back from the files that were written.

    Null and empty texts have an end token only; rows without an id have a null in the list of documents; repeated rows are documents
    of their own; pieces of equal length are taken by id, start and tokens."""
    return packing.packed_files(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("packed tokens", packed_tokens),
]

#: Fitted trees, draws and tokenising are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed rows."""
    s = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = s.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k > 0:
            s.drop(f"stage{k - 1}")
    return docs
