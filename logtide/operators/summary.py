"""Per-template summaries and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.functions.text import base_name, escape_tags, newline_breaks
from logtide.operators.classify import (
    DEFAULT_FAULT, DEFAULT_SIGNAL, first_fault, is_info, signal_distribution,
)
from logtide.plans.places import first_records


def template_summary(labelled: DataFrame) -> DataFrame:
    """Per template and file: first text, first signal, records, share of all."""
    return summary_of_representatives(
        first_records(labelled, ["template_id", "file_name"], ["text", "golden_signal"])
    )


def summary_of_representatives(labelled_reps: DataFrame) -> DataFrame:
    """The same from labelled representatives, without reading the records again."""
    total = labelled_reps.agg(F.sum("n").alias("_total"))
    return (
        labelled_reps.crossJoin(F.broadcast(total))
        .select(
            "template_id", "file_name",
            escape_tags(newline_breaks(F.col("text"))).alias("text"),
            F.col("golden_signal").alias("gs"), F.col("n").alias("d_tid_count"),
            F.round(F.col("n") / F.col("_total") * 100, 4).alias("coverage"),
        )
        .orderBy(is_info(F.col("gs")), "d_tid_count", "template_id", "file_name")
    )


def filter_summary(
    summary: DataFrame, signal: str = "", file: str = "", search: str = ""
) -> DataFrame:
    """Exact signal, exact file, words in the text; case does not matter."""
    if signal.strip():
        summary = summary.where(F.lower("gs") == signal.strip().lower())
    if file:
        summary = summary.where(F.lower("file_name") == file.lower())
    for word in search.lower().split():
        summary = summary.where(F.contains(F.lower("text"), F.lit(word)))
    return summary


def stat_cards(summary: DataFrame) -> DataFrame:
    """One row: summary rows, and those with error, latency, information."""
    signal = F.lower("gs")
    return summary.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(signal == "error").alias("errors"),
        F.count_if(signal == "latency").alias("latency"),
        F.count_if(signal == "information").alias("information"),
    )


def file_choices(summary: DataFrame) -> DataFrame:
    """Files by base name, case ignored."""
    return summary.select("file_name", base_name(F.col("file_name")).alias("base")).distinct().orderBy(
        F.lower("base"), "file_name"
    )


def analysis_result(reps: DataFrame, labelled_reps: DataFrame) -> DataFrame:
    """Per template and file: first line, labels with defaults, occurrences."""
    labels = labelled_reps.select("template_id", "file_name", "golden_signal", "fault_categories")
    return (
        reps.join(labels, ["template_id", "file_name"], "left")
        .select(
            "template_id", F.trim("text").alias("log_line"),
            F.coalesce("golden_signal", F.lit(DEFAULT_SIGNAL)).alias("golden_signal"),
            F.coalesce(first_fault(F.col("fault_categories")), F.lit(DEFAULT_FAULT)).alias("fault_category"),
            F.col("n").alias("occurrences"), "file_name",
        )
        .orderBy(F.desc("occurrences"), "template_id", "file_name")
    )


def analysis_totals(labelled_reps: DataFrame) -> DataFrame:
    """One row: records, templates, files."""
    return labelled_reps.agg(
        F.sum("n").alias("total_log_lines"),
        F.countDistinct("template_id").alias("templates_found"),
        F.countDistinct("file_name").alias("files"),
    )
