"""Raw documents to packed training sequences: five operators in a row, each over all the one before has kept.

Cases: a null text counts as an empty one, which the rules reject. A null source is a source of its own. Rows that
repeat a doc_id, or have none, are documents of their own, but for line dedup, where rows of one doc_id are one
document and rows without lose repeats of their own only. Texts are read whole, whatever their length; of equal
texts the one with the smallest doc_id stays. An empty table gives no rows. Other columns, whatever their names,
are kept up to the last stage. A text column that is not a string is an error.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logtide.llm import line_chunks, line_frequency, packing, pseudonyms, simhash  # noqa: E402
from logtide.llm.texts import documents  # noqa: E402
from logtide.plans.common import shared_dir  # noqa: E402


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with the recorded length of the text as it is now."""
    return docs.select(*[
        F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns
    ])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines that are frequent in their source."""
    return _measured(line_frequency.keep_good_documents(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two lines or more that an earlier document has go; every document stays."""
    return _measured(line_chunks.drop_shared_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.one_of_each_group(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses become pseudonyms."""
    return _measured(pseudonyms.pseudonymised(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its sequence and place."""
    return packing.packed_sequences(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("sequences", sequences),
]

ORACLE_SQL = None  # SQL has no XXH64, Feistel permutation, tokenizer or packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
