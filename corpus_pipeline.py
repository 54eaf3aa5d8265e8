"""Quality, exact and near duplicates, mixing, packing: five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridextremes.llm import exact_dedup, jaccard, mixing, packing
from gridextremes.llm.common import table
from gridextremes.llm.queries import TOKENIZER, judged_documents
from gridextremes.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, each row judged by itself.

    A null text is judged as an empty one. Rows that repeat stay or go together; an
    empty table gives an empty result; a text of any length is read whole.
    """
    return judged_documents(docs, spark, sf_dir).where("kept").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without ASCII white space: the longest, then that of the smallest id.

    Null and empty texts are one group, null ids come last, of rows that repeat
    entirely one stays, whole texts are compared however long they are.
    """
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents, that of the smallest id; rows are decided, not ids.

    So two different texts under one id both stay. A group without ids keeps one
    row too, and texts without words are similar to nothing and all stay. Long
    texts take part whole; an empty table gives an empty result.
    """
    return jaccard.one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row.

    Texts without words have no size and come along as they are; null sources are one
    source; rows that repeat are documents of their own; a long text counts with
    all its words; an empty table gives an empty result.
    """
    mix = mixing.mix_sources(docs, mixing.weight_table(docs)).where("copies > 0")
    return mix.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences.

    A null or empty text is its end mark alone; rows that repeat and rows without
    an id are packed like others; a long text is cut over as many sequences as it
    needs; an empty table gives an empty result.
    """
    return packing.pack(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", sequences),
]
ORACLE_SQL = None  # a fitted classifier, a knapsack and a tokenizer are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
