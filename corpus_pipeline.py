"""A training corpus from raw documents: five stages, each a Parquet table that the next one reads.

Every stage judges rows, not ids: of several rows with one id (or with none) only those
that it rejects go.  A null text is an empty one; an empty table passes as an empty table;
further columns, whatever their names, come along to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataloom.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from strataloom.llm._util import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the table labels, doesn't call toxic; empty texts are scored like others."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by id, of each group of near copies; rows without an id or without words all stay; equal rows are one."""
    return jaccard_join.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that a smaller id holds, cut at whole characters; a row of which nothing is left goes.

    n_chars, if there, is counted anew (0 for a null text).  Rows without an id keep their text.
    """
    cut = suffix_dedup.remove_repeats(docs, with_text=True).filter("n_removed = 0 or kept <> ''")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")}
    return cut.select(*[new.get(c, F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the table benchmark; without items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the rows that are left; an empty text is its end token."""
    return packing.pack_sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The classifier, the similarity classes and the packing aren't SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again; the tables go when the session ends in good order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
