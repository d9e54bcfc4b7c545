"""Signal counts over time, per file and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.text import log_scaled
from logtide.operators.classify import SIGNALS, is_info
from logtide.plans.common import join_by_key

# Bin sizes with their names, the most bins wanted, signal order.
BIN_SIZES = {
    30: "30 sec", 60: "1 min", 300: "5 min", 900: "15 min",
    1800: "30 min", 3600: "1 hour", 21600: "6 hours", 86400: "1 day",
}
MAX_BINS = 100
SIGNAL_ORDER = ["error", "latency", "saturation", "traffic", "availability", "information"]


def bin_seconds(span: Column) -> Column:
    """Smallest bin with at most 100 bins over the span, beyond that whole hours."""
    size = F.when(span <= 30 * MAX_BINS, 30)
    for candidate in list(BIN_SIZES)[1:]:
        size = size.when(F.ceil(span / candidate) <= MAX_BINS, candidate)
    return size.otherwise(F.ceil(span / MAX_BINS / 3600) * 3600).cast("long")


def bin_name(size: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in BIN_SIZES.items() for x in kv])
    return F.coalesce(
        F.try_element_at(names, size.cast("int")),
        F.concat(F.floor(size / 3600).cast("string"), F.lit(" hours")),
    )


def bin_label(start: Column, size: Column) -> Column:
    at = F.timestamp_seconds(start)
    return (
        F.when(size >= 86400, F.date_format(at, "yyyy-MM-dd"))
        .when(size >= 3600, F.date_format(at, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(at, "MM-dd HH:mm"))
    )


def file_bins(points: DataFrame) -> DataFrame:
    """Per file: first epoch, bin size, last bin, signals present, point count."""
    spans = points.groupBy("file_name").agg(
        F.min("epoch").alias("min_epoch"), F.max("epoch").alias("max_epoch"),
        F.collect_set("signal").alias("present"), F.count(F.lit(1)).alias("n"),
    )
    size = bin_seconds(F.col("max_epoch") - F.col("min_epoch"))
    known = F.array(*map(F.lit, SIGNAL_ORDER))
    return spans.withColumn("bin_seconds", size).select(
        "file_name", "min_epoch", "bin_seconds", "n",
        F.floor((F.col("max_epoch") - F.col("min_epoch")) / F.col("bin_seconds")).alias("max_bin"),
        F.array_union(
            F.filter(known, lambda s: F.array_contains(F.col("present"), s)),
            F.array_sort(F.array_except("present", known)),
        ).alias("signals"),
    )


def signal_timeline(labelled: DataFrame) -> DataFrame:
    """Dense counts per file, bin and signal present in the file."""
    points = labelled.groupBy(
        "file_name", "epoch", F.lower("golden_signal").alias("signal")
    ).agg(F.count(F.lit(1)).alias("c"))
    bins = file_bins(points)
    placed = join_by_key(
        points, bins.select("file_name", "n", "min_epoch", "bin_seconds"), ["file_name"], "n", "inner"
    )
    index = F.floor((F.col("epoch") - F.col("min_epoch")) / F.col("bin_seconds"))
    counts = placed.groupBy("file_name", index.alias("bin_idx"), "signal").agg(F.sum("c").alias("count"))
    grid = (
        bins.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_bin"))))
        .withColumn("signal", F.explode("signals"))
    )
    start = F.col("min_epoch") + F.col("bin_idx") * F.col("bin_seconds")
    return grid.join(counts, ["file_name", "bin_idx", "signal"], "left").select(
        "file_name", "bin_seconds", bin_name(F.col("bin_seconds")).alias("bin_name"), "bin_idx",
        start.alias("bin_start"), bin_label(start, F.col("bin_seconds")).alias("label"),
        "signal", F.coalesce("count", F.lit(0)).alias("count"),
        log_scaled(F.coalesce("count", F.lit(0))).alias("scaled"),
    )


def timeline_documents(timeline: DataFrame) -> DataFrame:
    """Nested form, one row per file (about a hundred bins each)."""
    bins = timeline.groupBy("file_name", "bin_seconds", "bin_name", "bin_idx", "bin_start", "label").agg(
        F.sort_array(F.collect_list(F.struct("signal", "count"))).alias("counts")
    )
    entry = F.struct("bin_idx", F.col("bin_start").alias("start"), "label", "counts")
    return bins.groupBy("file_name", "bin_seconds", "bin_name").agg(
        F.sort_array(F.collect_list(entry)).alias("bins")
    )


def temporal_evolution(labelled: DataFrame, rows: int = 30) -> DataFrame:
    """Counts per non-information signal in equal bins over the whole span, empty bins included."""
    shown = labelled.where(~is_info(F.col("golden_signal"))).select(
        "epoch", F.lower("golden_signal").alias("signal")
    )
    span = shown.agg(F.min("epoch").alias("_min"), F.max("epoch").alias("_max"))
    width = F.greatest(F.floor((F.col("_max") - F.col("_min")) / rows), F.lit(1))
    span = span.select("_min", "_max", width.alias("_width"))
    index = F.floor((F.col("epoch") - F.col("_min")) / F.col("_width"))
    names = [s for s in SIGNALS if s != "information"]
    counts = (
        shown.crossJoin(F.broadcast(span)).groupBy(index.alias("bin_idx"))
        .agg(*[F.count_if(F.col("signal") == s).alias(s) for s in names])
    )
    last = F.floor((F.col("_max") - F.col("_min")) / F.col("_width"))
    # About as many bins as rows asked for; those without records are there too.
    bins = span.where("_min IS NOT NULL").select(
        "_min", "_width", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin_idx")
    )
    return bins.join(counts, "bin_idx", "left").select(
        "bin_idx", (F.col("_min") + F.col("bin_idx") * F.col("_width")).alias("start_epoch"),
        *[F.coalesce(s, F.lit(0)).alias(s) for s in names],
    )
