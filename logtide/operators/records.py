"""From physical lines to log records: parse, fold, filter, truncate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import and_

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.functions.text import (
    ascii_fold, clean_for_classifier, collapse_spaces, digit_count, letter_count, token_count, without,
)
from logtide.functions.timestamps import extract_timestamp, json_time_epoch
from logtide.plans.common import materialize

# Seconds covered by the named time ranges.
DAY = 24 * 60 * 60
TIME_RANGES = {
    "1-day": DAY, "2-day": 2 * DAY, "3-day": 3 * DAY, "4-day": 4 * DAY, "5-day": 5 * DAY,
    "6-day": 6 * DAY, "1-week": 7 * DAY, "2-week": 14 * DAY, "3-week": 21 * DAY, "1-month": 30 * DAY,
}
# Lines per chunk, as a power of two: folding never sorts more than one chunk.
CHUNK_BITS = 16
NUMERIC_LIMIT = 0.65
Z_LIMIT = 2
FOLDED, JSON, UNTIMED = 0, 1, 2  # order of the record sections


# --- JSON lines ---------------------------------------------------------------


def is_json_object(value: Column) -> Column:
    """True for text that parses to an object with at least one field."""
    parsed = F.try_parse_json(value)
    fields = F.size(parsed.try_cast("map<string,variant>"))
    return F.when(F.startswith(F.ltrim(value, F.lit(" \t\r\n\f\x0b")), F.lit("{")),
                  F.coalesce(fields > 0, F.lit(False))).otherwise(False)


def split_json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text lines, JSON object lines)."""
    flagged = lines.withColumn("_json", is_json_object(F.col("value")))
    return flagged.where("NOT _json").drop("_json"), flagged.where("_json").drop("_json")


def flatten_json(value: Column, sep: str = "_") -> Column:
    """map<string,string> of a nested object, key paths joined; lists stay JSON text.

    Nesting depth is open, which no built-in expression covers.
    """

    @F.pandas_udf("map<string,string>")
    def flat(texts: pd.Series) -> pd.Series:
        def one(text):
            out, open_nodes = {}, [("", json.loads(text))]
            while open_nodes:
                prefix, node = open_nodes.pop()
                for key, item in node.items():
                    if isinstance(item, dict):
                        open_nodes.append((f"{prefix}{key}{sep}", item))
                    else:
                        out[prefix + key] = item if isinstance(item, str) else json.dumps(item)
            return out

        return texts.map(lambda t: None if t is None else one(t))

    return flat(value)


def json_records(
    lines: DataFrame, time_keys: Sequence[str], message_keys: Sequence[str], as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, discarded lines) of JSON object lines.

    A key with '_' may be the joined path of a nested field: then each object is
    flattened once, else its fields are read as they are.
    """
    if any("_" in key for key in [*time_keys, *message_keys]):
        read = lines.withColumn("_fields", flatten_json(F.col("value")))
        fields = lambda keys: [F.try_element_at("_fields", F.lit(k)) for k in keys]
    else:
        read = lines.withColumn("_fields", F.try_parse_json("value"))
        fields = lambda keys: [F.try_variant_get("_fields", f"$['{k}']", "string") for k in keys]
    none = F.lit(None).cast("string")
    read = read.withColumn("ts_text", F.coalesce(*fields(time_keys), none)).withColumn(
        "_message", F.coalesce(*fields(message_keys), none)
    )
    read = read.withColumn(
        "epoch", F.when(F.col("ts_text").isNotNull(), json_time_epoch("ts_text", as_of))
    )
    # A time of zero counts as none.
    kept = F.col("_message").isNotNull() & F.coalesce(F.col("epoch") != 0, F.lit(False))
    place = [c for c in lines.columns if c != "value"]
    good = read.where(kept).select(
        *place, "ts_text", "epoch",
        collapse_spaces(ascii_fold(F.trim("_message"))).alias("text"),
    )
    bad = read.where(~kept).select(*lines.columns)
    return with_counts(good), bad


# --- text lines ---------------------------------------------------------------


def with_counts(parsed: DataFrame) -> DataFrame:
    """Classifier text and the letter, digit and token counts of a line."""
    return _counted(parsed.select("*", clean_for_classifier(F.col("text")).alias("clean_text")))


def _counted(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "*", *_counts(F.col("text"), F.col("ts_text")), token_count(F.col("text")).alias("token_count")
    )


def _counts(text: Column, ts_text: Column) -> list[Column]:
    """Digits, and letters and digits plus one, of a line without its timestamp."""
    rest = without(text, ts_text)
    digits = digit_count(rest)
    return [digits.alias("digit_count"), (digits + letter_count(rest) + 1).alias("char_count")]


def parse_lines(
    lines: DataFrame, as_of: datetime, order: Sequence[int] | None = None, **options
) -> DataFrame:
    """Timestamp and cleaned text of every line; ``order`` as in extract_timestamp."""
    found = lines.withColumn("_ts", extract_timestamp("value", as_of, order, **options))
    return found.select(
        *[c for c in lines.columns if c != "value"],
        F.col("_ts.ts_text").alias("ts_text"),
        F.col("_ts.epoch").alias("epoch"),
        collapse_spaces(ascii_fold(F.col("value"))).alias("text"),
    )


def fold_chunks(parsed: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Fold continuation lines into the timestamped line above, chunk by chunk.

    A chunk is a bounded run of lines of one file, so one file of any size
    spreads over many tasks; the same partitioning serves the running head and
    the grouping. Lines above a chunk's first timestamp come out as one row
    with a null ``head`` that keeps its lines apart for ``stitch``. Every text is there
    once, in ``texts`` or in ``lines``; texts for the classifier, and the digits and letters
    of ``lines``, are found where they are read.
    """
    key = ["file_name", "block_start", "chunk"]
    chunked = parsed.withColumn("chunk", F.shiftright("line_seq", chunk_bits))
    running = Window.partitionBy(*key).orderBy("line_seq")
    stamped = F.when(F.col("epoch").isNotNull(), F.col("line_seq"))
    headed = (
        chunked.withColumn("head", F.last(stamped, ignorenulls=True).over(running))
        .withColumn("last_head", F.max(stamped).over(Window.partitionBy(*key)))
    )
    known = F.col("head").isNotNull()
    headed = headed.select(
        "*", *[F.when(known, c).alias(n) for n, c in zip(MEASURES[4:6], _counts(F.col("text"), F.col("ts_text")))],
        token_count(F.col("text")).alias("token_count"),
    )
    line = F.struct("line_seq", "text", F.when(~known, F.col("ts_text")).alias("ts_text"), "token_count")
    folded = headed.groupBy(*key, "last_head", "head").agg(
        F.max("epoch").alias("epoch"),
        F.max("ts_text").alias("ts_text"),
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.sum("digit_count").alias("digit_count"),
        F.sum("char_count").alias("char_count"),
        F.sum("token_count").alias("token_count"),
    )
    orphan = F.col("head").isNull()
    return folded.select(
        *key, "head", "epoch", "ts_text",
        F.coalesce(F.col("head") == F.col("last_head"), F.lit(False)).alias("is_last"),
        F.when(~orphan, F.col("lines.text")).alias("texts"),
        "digit_count", "char_count", "token_count",
        F.when(orphan, F.col("lines")).alias("lines"),
    )


def _sums(lines: str) -> list[Column]:
    """The sums of the counts of several lines, null if all are."""
    def total(n: int, name: str) -> Column:
        counts = F.transform(lines, lambda l: _counts(l["text"], l["ts_text"])[n])
        none = F.lit(None).cast("long")
        return F.aggregate(F.filter(counts, lambda c: c.isNotNull()), none, lambda a, c: F.coalesce(a + c, c)).alias(name)

    return [total(0, "digit_count"), total(1, "char_count")]


def _texts(lines: str) -> list[Column]:
    """The text and the classifier text of several lines, which are never null."""
    clean = F.array_join(F.transform(lines, clean_for_classifier), "\n")
    return [
        F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"),
        F.coalesce(clean, F.lit("")).alias("clean_text"),
    ]


def _chunk_heads(folded: DataFrame) -> DataFrame:
    """Per chunk: the record that is open when the chunk starts, and whether its
    file has any timestamp. One small row per chunk goes through the window."""
    chunks = folded.groupBy("file_name", "block_start", "chunk").agg(F.max("head").alias("last_head"))
    place = F.when(
        F.col("last_head").isNotNull(), F.struct("block_start", "chunk", "last_head")
    )
    before = (
        Window.partitionBy("file_name").orderBy("block_start", "chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("file_name")
    return chunks.select(
        "file_name", "block_start", "chunk",
        F.last(place, ignorenulls=True).over(before).alias("open"),
        F.max("last_head").over(whole).isNotNull().alias("timed"),
    )


def _record_id(section: int, block: Column, line: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), F.col("file_name").alias("file_name"),
        block.alias("block_start"), line.alias("line_seq"),
    ).alias("record_id")


MEASURES = ["epoch", "ts_text", "text", "clean_text", "digit_count", "char_count", "token_count"]


def _joined(column: str, order: Column) -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(column).alias("v"))))
    return F.array_join(pairs["v"], "\n").alias(column)


def stitch(folded: DataFrame, cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records of files with timestamps, lines of files without any).

    Only the rows at chunk borders move: each chunk's leading lines to the
    record they continue, and that record to them. Lines of files without any timestamp
    stay where they are; they ask a table of files. ``cut`` writes the small
    tables of chunks and files, which several branches ask.
    """
    heads = _chunk_heads(folded)
    if cut:
        heads = materialize(heads, "chunks")
    files = heads.groupBy("file_name").agg(F.max("timed").alias("timed"))
    if cut:
        files = materialize(files, "files")
    placed = folded.where("head IS NULL AND block_start IS NOT NULL AND chunk IS NOT NULL").join(files, "file_name")
    orphans = placed.where("timed").select(
        "file_name", "block_start", "chunk", "timed", *_texts("lines.text"), *_sums("lines"), "token_count"
    ).join(heads.drop("timed"), ["file_name", "block_start", "chunk"])
    order = F.struct("block_start", "chunk")
    texts = [_joined("text", order), _joined("clean_text", order)]
    counts = [F.sum(c).alias(c) for c in ("digit_count", "char_count", "token_count")]
    tails = (
        orphans.where("open IS NOT NULL")
        .groupBy("file_name", F.col("open.block_start").alias("o_block"), F.col("open.chunk").alias("o_chunk"))
        .agg(*texts, *counts)
        .select(
            "file_name", F.col("o_block").alias("block_start"), F.col("o_chunk").alias("chunk"),
            F.struct("text", "clean_text", "digit_count", "char_count", "token_count").alias("tail"),
        )
    )
    headed = folded.where("head IS NOT NULL").select(
        *[c for c in folded.columns if c not in ("texts", "lines")], *_texts("texts")
    )
    closing = headed.where("is_last").join(tails, ["file_name", "block_start", "chunk"], "left")
    extended = [
        F.concat_ws("\n", c, f"tail.{c}").alias(c) for c in ("text", "clean_text")
    ] + [
        (F.col(c) + F.coalesce(f"tail.{c}", F.lit(0))).alias(c)
        for c in ("digit_count", "char_count", "token_count")
    ]
    identity = [_record_id(FOLDED, F.col("block_start"), F.col("head")), "file_name"]
    inner = headed.where("NOT is_last").select(*identity, *MEASURES)
    closed = closing.select(*identity, "epoch", "ts_text", *extended)
    # Lines above a file's first timestamp: one record without time.
    leading = (
        orphans.where("open IS NULL AND timed").groupBy("file_name").agg(*texts, *counts)
        .withColumn("epoch", F.lit(None).cast("double"))
        .withColumn("ts_text", F.lit(None).cast("string"))
        .select(_record_id(FOLDED, F.lit(-1).cast("long"), F.lit(-1).cast("long")), "file_name", *MEASURES)
    )
    # Null with the text and not otherwise, as the planner sees too: what isn't read isn't made to look for nulls.
    line, there = F.col("l.text"), F.col("l.text").isNotNull()
    clean = F.when(there, F.coalesce(clean_for_classifier(line), F.lit("")))
    numbers = [
        F.when(there, F.coalesce(count, F.lit(0).cast("long"))).alias(name)
        for name, count in zip(MEASURES[4:6], _counts(line, F.col("l.ts_text")))
    ]
    untimed = (
        placed.where("NOT timed")
        .select("file_name", "block_start", F.explode("lines").alias("l"))
        .select(
            _record_id(UNTIMED, F.col("block_start"), F.col("l.line_seq")), "file_name",
            F.lit(None).cast("double").alias("epoch"), F.lit(None).cast("string").alias("ts_text"),
            "l.text", clean.alias("clean_text"), *numbers, "l.token_count",
        )
    )
    return inner.unionByName(closed).unionByName(leading), untimed


def segment_records(
    parsed: DataFrame, chunk_bits: int = CHUNK_BITS, cut: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Fold and stitch. ``cut`` writes the folded chunks once, so that parsing
    is not repeated by the consumers that follow."""
    folded = fold_chunks(parsed, chunk_bits)
    return stitch(materialize(folded, "folded") if cut else folded, cut)


def as_json_section(parsed: DataFrame) -> DataFrame:
    """JSON lines in record form."""
    return parsed.select(
        _record_id(JSON, F.col("block_start"), F.col("line_seq")), "file_name", *MEASURES
    )


# --- filters over records -----------------------------------------------------


def numeric_ratio_filter(records: DataFrame, limit: float = NUMERIC_LIMIT) -> DataFrame:
    """Drop records made mostly of digits."""
    return records.where(F.col("digit_count") / F.col("char_count") < limit)


def time_range_filter(records: DataFrame, time_range: str) -> DataFrame:
    """Keep the records of the last named range before the latest one."""
    if time_range == "all-data":
        return records
    if time_range not in TIME_RANGES:
        raise ValueError(f"unknown time range {time_range!r}")
    latest = records.agg(F.max("epoch").alias("_latest"))
    return (
        records.crossJoin(F.broadcast(latest))
        .where(F.col("epoch") >= F.col("_latest") - TIME_RANGES[time_range])
        .drop("_latest")
    )


def interval_filter(records: DataFrame, start: float | str, seconds: float) -> DataFrame:
    """Records within [start, start + seconds]; a start given as text is an ISO date or time, UTC unless it says so."""
    if isinstance(start, str):
        moment = datetime.fromisoformat(start)
        start = (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp()
    return records.where(F.col("epoch").between(start, start + seconds))


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row: time span, mean and sample deviation of the token count."""
    return records.agg(
        F.min("epoch").alias("min_epoch"), F.max("epoch").alias("max_epoch"),
        F.avg("token_count").alias("mean_tokens"), F.stddev_samp("token_count").alias("sd_tokens"),
        F.count(F.lit(1)).alias("num_records"),
    )


def truncate_long(
    records: DataFrame, z_limit: float = Z_LIMIT, unit: str = "character", stats: DataFrame | None = None
) -> DataFrame:
    """Add z_score and truncated_log: texts with more than int(mean + z sd) tokens
    keep that many characters (``unit='token'``: tokens). ``stats`` is the row of
    ``corpus_stats``, if there already."""
    stats = (stats if stats is not None else corpus_stats(records)).select(
        F.col("mean_tokens").alias("_mean"),
        F.when(F.col("sd_tokens") > 0, F.col("sd_tokens")).alias("_sd"),
    )
    bound = F.floor(F.col("_mean") + z_limit * F.col("_sd")).cast("int")
    if unit == "token":
        cut = F.array_join(F.slice(F.split("text", " ", -1), 1, bound), " ")
    else:
        cut = F.substring(F.col("text"), F.lit(1), bound)
    return (
        records.crossJoin(F.broadcast(stats))
        .withColumn(
            "z_score",
            F.coalesce((F.col("token_count") - F.col("_mean")) / F.col("_sd"), F.lit(0.0)),
        )
        .withColumn(
            "truncated_log",
            F.when(F.col("token_count") > bound, cut).otherwise(F.col("text")),
        )
        .drop("_mean", "_sd")
    )


def truncation_count(truncated: DataFrame, z_limit: float = Z_LIMIT) -> DataFrame:
    """One row: records the truncation concerns."""
    return truncated.agg(F.count_if(F.col("z_score") > z_limit).alias("num_truncated"))


def drop_incomplete(records: DataFrame) -> DataFrame:
    """Rows without a null or NaN; ``na.drop`` would make every column for it, whatever is read."""
    there = [
        F.col(name).isNotNull() & ~F.isnan(name) if kind in ("double", "float") else F.col(name).isNotNull()
        for name, kind in records.dtypes
    ]
    return records.where(reduce(and_, there))


def build_records(
    timed: DataFrame,
    untimed: DataFrame,
    json_lines: DataFrame | None = None,
    time_range: str = "all-data",
    as_of: datetime | None = None,
) -> DataFrame:
    """Union of the record sections, filtered, truncated and complete.

    Lines of files without timestamps get the latest epoch found, or ``as_of``.
    """
    records = timed if json_lines is None else timed.unionByName(as_json_section(json_lines))
    records = numeric_ratio_filter(records).withColumn("_dated", F.lit(True)).unionByName(
        untimed.withColumn("_dated", F.lit(False))
    )
    # One small row; over the whole data its token figures are the corpus's too.
    stats = corpus_stats(records)
    fallback = F.lit(as_of.timestamp() if as_of else None).cast("double")
    latest = stats.select(F.coalesce("max_epoch", fallback).alias("_latest"))
    shown = F.date_format(F.timestamp_seconds(F.floor("_latest")), "yyyy-MM-dd HH:mm:ss")
    records = (
        records.crossJoin(F.broadcast(latest))
        .withColumn("epoch", F.when(F.col("_dated"), F.col("epoch")).otherwise(F.col("_latest")))
        .withColumn("ts_text", F.when(F.col("_dated"), F.col("ts_text")).otherwise(shown))
        .drop("_latest", "_dated")
    )
    if time_range != "all-data":
        records, stats = time_range_filter(records, time_range), None
    return drop_incomplete(truncate_long(records, stats=stats)).select(
        "record_id", "file_name", "epoch", "ts_text", "text", "clean_text", "truncated_log"
    )
