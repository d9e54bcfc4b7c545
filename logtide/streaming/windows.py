"""Tumbling windows over log files as they arrive.

The same expressions as in batch; a static template table supplies the labels.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.functions.text import clean_line
from logtide.functions.timestamps import extract_timestamp
from logtide.operators.templates import shape_key, shape_text
from logtide.operators.windows import WINDOW_SECONDS


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that appear in a folder."""
    return spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file_name"), "value"
    )


def window_counts(
    lines: DataFrame,
    labels: DataFrame,
    as_of: datetime,
    seconds: int = WINDOW_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Timestamped lines per window and signal.

    ``labels`` maps shape keys to golden signals (key, golden_signal); lines of
    unknown shape count as information. Lines later than ``lateness`` are left out.
    """
    stamped = (
        lines.withColumn("ts", F.timestamp_micros(
            (extract_timestamp("value", as_of)["epoch"] * 1000000).cast("long")
        ))
        .where("ts IS NOT NULL")
        .withWatermark("ts", lateness)
        .withColumn("key", shape_key(shape_text(clean_line(F.col("value")))))
    )
    return (
        stamped.join(labels, "key", "left")
        .groupBy(
            F.window("ts", f"{seconds} seconds").alias("w"),
            F.coalesce("golden_signal", F.lit("information")).alias("golden_signal"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select((F.unix_seconds("w.start") / seconds).cast("long").alias("win"), "golden_signal", "n")
    )
