"""The template and entry tables that later questions are asked of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logtide.functions.masking import var_count
from logtide.operators.classify import vote_signal
from logtide.plans.common import dense_id, materialize
from logtide.plans.places import place_in_file, place_order, records_at

REQUIRED = {"template_id", "template", "variables", "epoch", "file_name"}
FILES_PER_MAP = 1000  # files that one map of counts names; further ones are in further maps


def check_columns(records: DataFrame) -> None:
    missing = REQUIRED - set(records.columns)
    if missing:
        raise ValueError(f"columns needed for the store are missing: {sorted(missing)}")


def template_files(records: DataFrame) -> DataFrame:
    """Records per template and file: the whole of the file counts."""
    return records.groupBy("template_id", F.col("file_name").alias("file_source")).agg(
        F.count(F.lit(1)).alias("n")
    )


def template_file_maps(files: DataFrame, per_map: int = FILES_PER_MAP) -> DataFrame:
    """The counts of ``template_files`` as maps: (template_id, piece, file_sources), pieces in order of file name."""
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("file_source"))
    entry = F.struct("file_source", "n")
    return files.withColumn("piece", F.floor((place - 1) / per_map)).groupBy("template_id", "piece").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("file_sources")
    )


def template_table(
    records: DataFrame, labelled_reps: DataFrame, components: DataFrame | None = None
) -> DataFrame:
    """One row per template; its counts by file are in ``template_files``.

    Records are reduced to places per template and file by hash aggregates on
    numbers, and the texts of the records that stand there are fetched. The
    component comes from ``components``, else from the records.
    """
    check_columns(records)
    has_component = "component" in records.columns
    component = F.col("component") if has_component else F.lit(None).cast("string")
    placed = records.select(
        "template_id", "file_name", place_in_file().alias("place"), "template", component.alias("_component"), "text"
    )
    per_file = placed.groupBy("template_id", "file_name").agg(
        F.min("place").alias("place"), F.min(F.when(F.col("text") != "", F.col("place"))).alias("filled"),
        F.count(F.lit(1)).alias("n"),
    )
    places = materialize(
        per_file.groupBy("template_id").agg(
            F.min(place_order("file_name", "place")).alias("first"),
            F.min(F.when(F.col("filled").isNotNull(), place_order("file_name", "filled"))).alias("rep"),
            F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("file_count"),
        ),
        "template-places",
    )
    wanted = places.select("template_id", F.explode(F.array_distinct(F.array("first", "rep"))).alias("at"))
    wanted = materialize(wanted.where("at IS NOT NULL").select("template_id", "at.file_name", "at.place"), "wanted")
    found = records_at(placed, wanted, ["template_id", "file_name", "place"])
    at = F.col("place").eqNullSafe(F.col("first.place")) & F.col("file_name").eqNullSafe(F.col("first.file_name"))
    rep = F.col("place").eqNullSafe(F.col("rep.place")) & F.col("file_name").eqNullSafe(F.col("rep.file_name"))
    # Two rows a template at most, so these buffers hold what is kept in the end.
    stats = found.join(places.withColumnRenamed("template_id", "_id"), F.col("template_id").eqNullSafe(F.col("_id"))).groupBy(
        "template_id", "occurrence_count", "file_count"
    ).agg(
        F.max(F.when(at, F.col("template"))).alias("template"), F.max(F.when(at, F.col("_component"))).alias("_component"),
        F.max(F.when(rep, F.col("text"))).alias("rep_log"),
    )
    named = F.col("_component")
    if components is not None:
        named = F.col("component")
        stats = stats.join(components.select("template_id", "component"), "template_id", "left")
    return (
        stats.join(vote_signal(labelled_reps), "template_id", "left")
        .select(
            "template_id", "template", var_count(F.col("template")).alias("var_count"),
            "golden_signal", "fault_category", "occurrence_count", named.alias("component"),
            F.coalesce("rep_log", F.lit("")).alias("rep_log"), "file_count",
        )
    )


def log_entries(records: DataFrame, dense: bool = False) -> DataFrame:
    """One row per record. ``entry_id`` is the record id, or with ``dense`` its
    position in record order."""
    check_columns(records)
    if dense:
        records = dense_id(records, [F.col("record_id")], "entry_id")
    else:
        records = records.withColumn("entry_id", F.col("record_id"))
    return records.select(
        "template_id", F.coalesce(F.col("epoch").cast("long"), F.lit(0)).alias("timestamp"),
        "variables", F.coalesce("file_name", F.lit("")).alias("file_source"),
        F.coalesce("text", F.lit("")).alias("original_text"), "entry_id",
    )


def store_totals(templates: DataFrame, entries: DataFrame) -> DataFrame:
    return templates.agg(F.count(F.lit(1)).alias("total_templates")).crossJoin(
        entries.agg(F.count(F.lit(1)).alias("total_entries"))
    )
