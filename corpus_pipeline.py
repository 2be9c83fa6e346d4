"""Corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, mixing, binary records.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the columns of documents; the last returns the offset index of the records that it wrote.

What holds for all stages: rows with null or empty texts, null doc_ids or null sources pass
like others, unless a stage says otherwise; very long texts are read whole; extra columns,
also of names that operators use themselves, are kept up to the last stage; an empty table
of documents gives an empty result, and empty labels or an empty benchmark keep every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, mixing, simhash_dedup, token_records, toxicity
from lodestrata.runtime import remove, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on the labelled ones of ``docs``, doesn't call toxic.

    Without labels of both kinds, and for texts without known words (null and empty ones too), nothing
    is toxic. Repeated rows and equal texts are judged alike.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, of equal doc_ids that of least text hash, of repeated rows one.

    Rows without words (null or empty texts) are in no group; of those that repeat a doc_id and text all stay.
    """
    return simhash_dedup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no n-gram of a benchmark item; repeated rows are judged alike, and so are equal texts."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn so that sources have tempered shares and the number of rows stays the same within one.

    A null source is a source. Rows that repeat a doc_id and source are drawn alike, the others of
    equal chance by hashes of their doc_id; a row drawn twice is there twice.
    """
    return mixing.mixed(docs)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A record for every row, in the shared folder, and its index; null and empty texts give records without tokens, repeated rows one each."""
    return token_records.write_records(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_records),
]

#: The classifier's training and the random rounding can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read by the next, after which it is deleted."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
