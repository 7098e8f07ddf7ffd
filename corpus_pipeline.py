"""The corpus pipeline: from raw documents to packed training sequences (counted as part of mosaiq.llm)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, jaccard, packing, quality, span_dedup
from mosaiq.llm.common import bound_batches, materialise, read_table

# What every stage does with odd rows: a null text counts as an empty one, which the classifier scores like any other,
# and which then is in no group, has no sentences and no words, and is packed as its end mark. Equal rows and rows of one
# doc_id stay or go together, except where a stage cuts their texts alike. Rows with a null doc_id are judged by
# their text alone and are never near duplicates. Columns beyond those of documents pass through all stages but the last,
# whatever their names; an empty table gives an empty one.


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier rejects go; it learns from the labelled rows of `documents`."""
    bound_batches(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, with all its rows."""
    bound_batches(spark)
    return jaccard.keep_one_each(docs)


def no_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans are cut out and n_chars follows; documents of which nothing is left go."""
    bound_batches(spark)
    own = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    odd = {c: f"__kept_{c}" for c in docs.columns if c not in own}  # names that the operator gives itself
    cut = span_dedup.dedup_spans(docs.withColumnsRenamed(odd)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*(F.col(odd.get(c, c)).alias(c) for c in docs.columns))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all their rows."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 1024 tokens; every row is packed for itself."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeated_spans", no_repeated_spans),
    ("benchmark", no_benchmark),
    ("packing", packed),
]
#: The stages' models and joins are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
