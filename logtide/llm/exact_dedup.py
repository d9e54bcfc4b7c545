"""Exact deduplication that no group of copies can slow down.

Texts are equal when they are identical once each run of white space is one space.
Copies are combined in three steps, each of which groups by digest and full text, so a
shared digest alone never joins two texts: within the task that read them (the partial
aggregate), within salted digest groups, and over the salts' winners. No task
receives more of one group than a row per task and salt.

Cases: a null text is an empty one. The row with the smallest doc_id stays; a null
doc_id counts as the largest and gets that keep_id only in a group without other ids.
Rows that repeat a doc_id are rows of their own in group_size, and each is marked kept
if its id is the group's. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.llm.texts import id_and_text

SALTS = 16


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per row: keep_id, group_size, kept and the digest of its normalised text."""
    rows = id_and_text(docs).select(
        "doc_id", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("text")
    ).withColumn("text_sha256", F.sha2("text", 256))
    # A second hash of the text makes the key of the join below as wide as two digests.
    rows = rows.withColumn("check", F.xxhash64("text"))
    group = ["text_sha256", "check", "text"]
    salted = rows.groupBy(*group, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    winners = salted.groupBy(*group).agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    # The members come back by digest, without their texts; a hot digest is split by the skew join.
    return rows.select("doc_id", "text_sha256", "check").join(
        winners.drop("text"), ["text_sha256", "check"]
    ).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
