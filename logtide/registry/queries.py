"""Queries: (spark, sf_dir) -> DataFrame, one per operator."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtide.functions import masking, text as tx, timestamps as tm, tokens as tk
from logtide.operators import (
    causality, classify, explore, records, store, summary, tags, templates, timeline, windows,
)
from logtide.plans.analysis import Analysis, analyze, preprocess
from logtide.plans.common import materialize, passing_tables, shared_dir
from logtide.plans.session import tune
from logtide.sources import archives, lines as ln, matcher, reports, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
ORDERS_AS_OF = datetime(1996, 6, 1, tzinfo=timezone.utc)
CHUNK = 10  # lines per chunk as a power of two: small, so that records cross chunks
SECONDS = 1800  # window length that gives windows of several events
TAGS = {
    "tags": [
        {"name": "Error", "keywords": ["error", "err"], "patterns": [r"\[error\]", "FATAL|ERROR"]},
        {"name": "Storage", "keywords": ["disk"], "patterns": [r"storage\s+volume", "("]},
        {"name": "Web", "keywords": ["click", "view"], "patterns": [r"\bresponse\s+slow\b"]},
    ],
    "default_tag": "Other",
}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


# --- inputs -------------------------------------------------------------------


def micros(epoch: Column) -> Column:
    return F.round(epoch * 1000000).cast("long")


def event_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = records.parse_lines(tables.event_lines(spark, sf_dir), AS_OF)
    return records.segment_records(parsed, CHUNK)


def document_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = tables.document_lines(spark, sf_dir).union(tables.event_lines(spark, sf_dir))
    return records.segment_records(records.parse_lines(lines, AS_OF), CHUNK)


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled records, 40 templates per event type."""
    kinds = F.array(*[F.lit(k) for k in tables.MESSAGES])
    kind = F.array_position(kinds, F.col("event_type"))
    scored = classify.rule_scores(F.col("message"), classify.SIGNAL_WORDS)
    faults = classify.fault_labels(classify.rule_scores(F.col("message"), classify.FAULT_WORDS))
    signal = classify.top_label(scored)
    rows = tables.spread_table(spark, sf_dir, "events").withColumn("message", tables._message())
    file_name = F.concat(F.lit("app-"), (F.col("user_id") % 8).cast("string"), F.lit(".log"))
    return rows.select(
        F.struct(
            F.lit(0).alias("section"), file_name.alias("file_name"),
            F.lit(0).cast("long").alias("block_start"), F.col("event_id").alias("line_seq"),
        ).alias("record_id"),
        file_name.alias("file_name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("epoch"),
        F.concat("message", F.lit(" by "), F.col("user_id").cast("string")).alias("text"),
        F.col("message").alias("clean_text"),
        (kind * 1000 + F.col("user_id") % 40).cast("long").alias("template_id"),
        F.concat("message", F.lit(" by <*>")).alias("template"),
        F.array(F.col("user_id").cast("string")).alias("variables"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        signal.alias("golden_signal"),
        F.when(classify.is_info(signal), F.array(F.lit("other"))).otherwise(faults).alias("fault_categories"),
    )


def event_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(tables.event_lines(spark, sf_dir), AS_OF, TAGS, chunk_bits=CHUNK)


# --- sources ------------------------------------------------------------------


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The event lines as a folder of text files."""
    path = f"{shared_dir(spark)}/event-lines-{uuid.uuid4().hex}"
    lines = tables.event_lines(spark, sf_dir).select(F.col("file_name").alias("file"), "line_seq", "value")
    (
        lines.repartition("file").sortWithinPartitions("file", "line_seq").select("file", "value")
        .write.mode("overwrite").partitionBy("file").text(path)
    )
    return path


def _file_of_path(path: Column) -> Column:
    return F.regexp_extract(path, "file=([^/]+)/", 1)


@query
def line_scan(spark, sf_dir):
    lines = ln.read_log_lines(spark, [_text_files(spark, sf_dir)])
    return lines.select(_file_of_path(F.col("file_name")).alias("file_name"), "value")


@query
def glob_scan(spark, sf_dir):
    """Folders that overlap and one named twice: each file is read once."""
    path = _text_files(spark, sf_dir)
    lines = ln.read_log_lines(spark, [f"{path}/file=app-[0-4].log", f"{path}/file=app-[0-4].log"], "*.txt")
    return lines.select(_file_of_path(F.col("file_name")).alias("file_name"), "value")


@query
def debug_outputs(spark, sf_dir):
    """The debug outputs written and read back: rows of each, and lines per template."""
    path = f"{shared_dir(spark)}/debug-{uuid.uuid4().hex}"
    rows = labelled_events(spark, sf_dir).withColumn("truncated_log", F.col("text"))
    untimed = tables.document_lines(spark, sf_dir).select(F.col("value").alias("text"))
    refused = tables.json_lines(spark, sf_dir).select("value")
    sinks.write_debug(path, untimed, refused, rows.select("record_id", "template_id", "text"), rows)
    counts = [
        spark.read.text(f"{path}/{name}").groupBy(F.lit(name).alias("name"), F.lit(0).cast("long").alias("template_id"))
        .agg(F.count(F.lit(1)).alias("n")) for name in ("none_logs", "json_discarded", "processed_logs")
    ]
    lines = spark.read.schema("template_id long, truncated_log string").json(f"{path}/matcher_output")
    per_template = lines.groupBy(F.lit("matcher_output").alias("name"), "template_id").agg(F.count(F.lit(1)).alias("n"))
    return per_template.unionByName(counts[0]).unionByName(counts[1]).unionByName(counts[2])


@query
def annotated_lines(spark, sf_dir):
    """Report lines, read apart again."""
    rows = labelled_events(spark, sf_dir)
    line = tx.annotated_line(F.col("text"), F.get("fault_categories", 0), F.col("golden_signal"))
    return rows.select(
        F.col("record_id.line_seq").alias("event_id"), tx.parse_annotated_line(line).alias("parts"),
        F.round(tx.log_height(F.col("record_id.line_seq")), 6).alias("height"),
    ).select("event_id", "parts.*", "height")


def _write_archives(documents: DataFrame, folder: str) -> None:
    """One zip per batch of documents, a member per document. Names depend on the
    rows only, so a repeated task replaces its own files."""

    def write(batches):
        filesystem, path = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        for pdf in batches:
            content = io.BytesIO()
            with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    archive.writestr(f"docs/{doc_id}.log", text)
            with filesystem.open_output_stream(f"{path}/docs-{pdf['doc_id'].min()}.zip") as out:
                out.write(content.getvalue())
            yield pdf[["doc_id"]]

    documents.select("doc_id", "text").mapInPandas(write, "doc_id long").write.format(
        "noop"
    ).mode("overwrite").save()


@query
def archive_lines(spark, sf_dir):
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    _write_archives(tables.spread_table(spark, sf_dir, "documents"), folder)
    found = archives.read_archives(spark, [folder])
    return found.select(
        F.regexp_extract("file_name", r"/docs/(\d+)\.log$", 1).cast("long").alias("doc_id"),
        "line_seq", "value",
    )


@query
def file_stats(spark, sf_dir):
    return ln.file_stats(tables.document_lines(spark, sf_dir))


@query
def file_selection(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages")
    suffix = F.element_at(
        F.array(*map(F.lit, [".log", ".txt", ".log.1", ".log2", ".txt.-3", ".csv", ".xml.bak", ".tsv", ""])),
        (F.col("page_id") % 9 + 1).cast("int"),
    )
    files = pages.select(
        F.col("url").alias("path"), F.concat(F.lit("f"), F.col("page_id").cast("string"), suffix).alias("name")
    )
    return ln.select_files(files, log_files=True, txt_files=True).select(
        "name", "processed", ln.named_file_selected(F.col("name")).alias("by_name")
    )


@query
def json_split(spark, sf_dir):
    lines = tables.json_lines(spark, sf_dir)
    return lines.select("line_seq", records.is_json_object(F.col("value")).alias("is_json"))


@query
def json_flatten(spark, sf_dir):
    _, objects = records.split_json_lines(tables.json_lines(spark, sf_dir))
    return objects.select("line_seq", F.explode(records.flatten_json(F.col("value"))).alias("key", "value"))


@query
def json_records(spark, sf_dir):
    _, objects = records.split_json_lines(tables.json_lines(spark, sf_dir))
    kept, _ = records.json_records(
        objects, ["time", "meta_time"], ["message", "body_message"], AS_OF
    )
    return kept.select(
        "line_seq", micros(F.col("epoch")).alias("epoch_us"), "text", "clean_text",
        "digit_count", "char_count", "token_count",
    )


@query
def json_discarded(spark, sf_dir):
    _, objects = records.split_json_lines(tables.json_lines(spark, sf_dir))
    return records.json_records(objects, ["time"], ["message"], AS_OF)[1].select("line_seq", "value")


@query
def unquoted_csv(spark, sf_dir):
    path = f"{shared_dir(spark)}/processed-{uuid.uuid4().hex}"
    rows = labelled_events(spark, sf_dir).select(
        "template_id", "file_name", F.concat("text", F.lit("\n\\end")).alias("text"), "epoch"
    )
    sinks.write_unquoted_csv(rows, path)
    return matcher.read_unquoted_csv(
        spark, path, "template_id long, file_name string, text string, epoch double",
        ["template_id", "text", "epoch"],
    ).select("template_id", "text", micros(F.col("epoch")).alias("epoch_us"))


# --- scalar functions -----------------------------------------------------------


def _documents(spark, sf_dir):
    return tables.document_lines(spark, sf_dir).select("file_name", "line_seq", "value")


@query
def ascii_fold(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "file_name", "line_seq", tx.clean_line(F.col("value")).alias("folded")
    )


@query
def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "file_name", "line_seq",
        tx.clean_for_classifier(tx.clean_line(F.col("value"))).alias("clean_text"),
    )


@query
def char_counts(spark, sf_dir):
    folded = _documents(spark, sf_dir).withColumn("t", tx.clean_line(F.col("value")))
    return folded.select(
        "file_name", "line_seq", tx.digit_count(F.col("t")).alias("digits"),
        tx.letter_count(F.col("t")).alias("letters"), tx.token_count(F.col("t")).alias("tokens"),
    )


def _order_times(spark, sf_dir, rendered: str, as_of=ORDERS_AS_OF, **options) -> DataFrame:
    lines = tables.order_lines(spark, sf_dir, rendered)
    found = lines.withColumn("t", tm.extract_timestamp("value", as_of, **options))
    return found.select("line_seq", F.col("t.ts_text"), micros(F.col("t.epoch")).alias("epoch_us"))


def _order_query(name: str, rendered: str, **options) -> None:
    def run(spark, sf_dir):
        return _order_times(spark, sf_dir, rendered, **options)

    run.__name__ = name
    query(run)


# Dates of the orders in the families of formats; ``t`` is the moment.
ORDER_FORMATS = {
    "ts_iso": "concat('at ', date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), 'Z')",
    "ts_space": "concat('time=', date_format(t, 'yyyy-MM-dd HH:mm:ss'), ',', '250')",
    "ts_us": "date_format(t, 'MM/dd/yy HH:mm:ss')",
    "ts_us_year": "concat('[', date_format(t, 'M/d/yyyy, H:m:s'), ' AM]')",
    "ts_day_first": "date_format(t, 'dd.MM.yyyy HH:mm:ss')",
    "ts_apache": "concat('10.0.0.1 - - [', date_format(t, 'dd/MMM/yyyy:HH:mm:ss'), ' -0700]')",
    "ts_syslog": "date_format(t, 'MMM dd HH:mm:ss')",
    "ts_weekday": "concat('Mon ', date_format(t, 'MMM dd HH:mm:ss'), ' ', date_format(t, 'yyyy'))",
    "ts_dashed": "date_format(t, 'yyyy-MM-dd-HH.mm.ss.SSSSSS')",
    "ts_packed": "concat(date_format(t, \"yyyyMMdd'T'HHmmss\"), '.125UTC')",
    "ts_clock": "concat(date_format(t, 'HH:mm:ss'), ',500')",
    "ts_hex": "lower(hex(unix_seconds(t)))",
    "ts_zone": "concat(date_format(t, 'yyyy-MM-dd HH:mm:ss'), ' JST')",
    "ts_offset": "concat(date_format(t, 'yyyy-MM-dd HH:mm:ss'), '+0530')",
}
for _name, _rendered in ORDER_FORMATS.items():
    _order_query(_name, _rendered)


@query
def ts_day_of_year(spark, sf_dir):
    # The format has years from 2000 on only.
    return _order_times(
        spark, sf_dir, "concat('20', date_format(t, 'yyDDD HH:mm:ss'), '.5')"
    )


@query
def ts_epoch(spark, sf_dir):
    # Moved on by 600 million seconds, to have ten digits everywhere.
    return _order_times(
        spark, sf_dir, "CAST(unix_seconds(t) + 600000000 AS string)",
        as_of=datetime(2016, 6, 1, tzinfo=timezone.utc),
    )


@query
def ts_source_zone(spark, sf_dir):
    return _order_times(
        spark, sf_dir, "date_format(t, 'yyyy/MM/dd-HH:mm:ss')", source_tz="Asia/Tokyo"
    )


@query
def ts_loose(spark, sf_dir):
    return _order_times(spark, sf_dir, "concat('(', date_format(t, 'yyyy-MM-dd HH:mm:ss'), ')')")


# One form of each of the looser patterns, and spans that overlap, by the remainder of the order's key.
LOOSE_FORMS = [
    "'x(', date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), 'Z)'",
    "'x(', date_format(t, 'yyyy/MM/dd HH:mm:ss'), ')'",
    "'x(', date_format(t, 'MMM dd HH:mm:ss'), ')'",
    "'x(', date_format(t, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000)'",
    "'x[', date_format(t, 'yyyy-MM-dd HH:mm:ss'), ']'",
    "'x(', date_format(t, 'yyyy-MM-dd) (HH:mm:ss'), ')'",
    "'x(', date_format(t, 'HH:mm:ss.SSS'), ')'",
    "'at last 1638360645 (', date_format(t, 'HH:mm:ss'), ')'",
    "'at last 1638360645123 (', date_format(t, 'HH:mm:ss'), ')'",
    "'x(', date_format(t, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT)'",
    "'x(', date_format(t, 'yyyyDDD HH:mm:ss'), '.50)'",
    "'at last 5f2c6e00 (', date_format(t, 'HH:mm:ss'), ')'",
    "'x(', date_format(t, 'HH:mm:yyyy-MM-dd HH:mm:ss'), ')'",
    "'x(', date_format(t, \"yyyy/MM/yyyy-MM-dd'T'HH:mm:ss\"), ')'",
]


@query
def ts_loose_forms(spark, sf_dir):
    forms = " ".join(f"WHEN {n} THEN concat({form})" for n, form in enumerate(LOOSE_FORMS))
    return _order_times(spark, sf_dir, f"CASE o_orderkey % {len(LOOSE_FORMS)} {forms} END")


@query
def ts_pattern_hits(spark, sf_dir):
    return tm.pattern_hits(tables.event_lines(spark, sf_dir))


@query
def json_time(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(
        "event_id", F.when(
            F.col("event_id") % 2 == 0,
            F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
        ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("t"),
    )
    return events.select("event_id", micros(tm.json_time_epoch("t", AS_OF)).alias("epoch_us"))


@query
def display_values(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    number = F.col("record_id.line_seq")
    return rows.select(
        number.alias("id"),
        tm.epoch_to_utc_string(F.col("epoch")).alias("utc"),
        tm.epoch_to_zone_string(F.col("epoch"), "Asia/Kolkata").alias("local"),
        tx.size_display(number * 977).alias("size"),
        tx.thousands(number * 977).alias("grouped"),
        F.round(tx.log_scaled(number), 2).alias("scaled"),
        tx.base_name(F.concat(F.lit("/var/log/"), F.col("file_name"))).alias("base"),
        tx.annotated_line(
            F.concat("text", F.lit("\nnext")), classify.first_fault(F.col("fault_categories")),
            F.col("golden_signal"),
        ).alias("line"),
    )


@query
def text_preview(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", tx.preview(F.col("text")).alias("preview"), tx.newline_breaks(F.col("text")).alias("breaks")
    )


@query
def escape_tags(spark, sf_dir):
    return tables.spread_table(spark, sf_dir, "pages").select(
        "page_id", tx.escape_tags(F.col("html")).alias("escaped")
    )


@query
def strip_tags(spark, sf_dir):
    return tables.spread_table(spark, sf_dir, "pages").select(
        "page_id", tx.strip_tags(F.col("html")).alias("stripped")
    )


@query
def bracket_tokens(spark, sf_dir):
    lines = tables.event_lines(spark, sf_dir)
    return lines.select(
        "line_seq", F.array_join(tk.bracket_tokens(F.col("value")), "|").alias("tokens")
    )


@query
def distinct_tokens(spark, sf_dir):
    return tags.distinct_tokens(
        tables.event_lines(spark, sf_dir).select(F.col("value").alias("text"))
    )


# --- records --------------------------------------------------------------------


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "file_name", F.col("record_id.line_seq").alias("line_seq"),
        micros(F.col("epoch")).alias("epoch_us"), "ts_text", "text", "clean_text",
        "digit_count", "char_count", "token_count",
    )


@query
def segment_records(spark, sf_dir):
    timed, _ = event_records(spark, sf_dir)
    return _shown(timed)


@query
def untimed_lines(spark, sf_dir):
    _, untimed = document_records(spark, sf_dir)
    return _shown(untimed).drop("epoch_us", "ts_text", "clean_text")


@query
def numeric_ratio(spark, sf_dir):
    timed, _ = event_records(spark, sf_dir)
    return _shown(records.numeric_ratio_filter(timed, 0.3)).select("file_name", "line_seq")


@query
def time_range(spark, sf_dir):
    return records.time_range_filter(labelled_events(spark, sf_dir), "1-week").select(
        F.col("record_id.line_seq").alias("event_id")
    )


@query
def interval_from_text(spark, sf_dir):
    return records.interval_filter(labelled_events(spark, sf_dir), "2024-01-10T05:30:00+05:30", 86400).select(
        F.col("record_id.line_seq").alias("event_id")
    )


@query
def interval_filter(spark, sf_dir):
    start = datetime(2024, 1, 10, tzinfo=timezone.utc).timestamp()
    return records.interval_filter(labelled_events(spark, sf_dir), start, 3 * 86400).select(
        F.col("record_id.line_seq").alias("event_id")
    )


def _document_rows(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", "text", tx.token_count(F.col("text")).alias("token_count"),
        F.col("doc_id").cast("double").alias("epoch"),
    )


@query
def corpus_stats(spark, sf_dir):
    return records.corpus_stats(_document_rows(spark, sf_dir)).select(
        "num_records", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("sd_tokens", 6).alias("sd_tokens"),
        "min_epoch", "max_epoch",
    )


@query
def truncate_long(spark, sf_dir):
    return records.truncate_long(_document_rows(spark, sf_dir)).select(
        "doc_id", "truncated_log", F.round("z_score", 6).alias("z_score")
    )


@query
def truncation_count(spark, sf_dir):
    return records.truncation_count(records.truncate_long(_document_rows(spark, sf_dir)))


@query
def build_records(spark, sf_dir):
    timed, untimed = document_records(spark, sf_dir)
    built = records.build_records(timed, untimed, as_of=AS_OF)
    return built.select(
        "file_name", F.col("record_id.line_seq").alias("line_seq"),
        micros(F.col("epoch")).alias("epoch_us"), "ts_text", "truncated_log",
    )


@query
def json_section(spark, sf_dir):
    """Text, JSON and untimed lines in one run; the keys of the JSON objects lie levels deep."""
    lines = tables.event_lines(spark, sf_dir).union(tables.document_lines(spark, sf_dir)).union(
        tables.nested_json_lines(spark, sf_dir)
    )
    built, _ = preprocess(
        lines, AS_OF, json_time=[tables.NESTED_TIME], json_message=[tables.NESTED_MESSAGE], chunk_bits=CHUNK
    )
    return built.select(
        F.col("record_id.section").alias("section"), "file_name", F.col("record_id.line_seq").alias("line_seq"),
        micros(F.col("epoch")).alias("epoch_us"), "ts_text", "truncated_log",
    )


# --- templates ------------------------------------------------------------------


@query
def mask_variables(spark, sf_dir):
    lines = tables.event_lines(spark, sf_dir).union(tables.document_lines(spark, sf_dir))
    return lines.select(
        "file_name", "line_seq", masking.mask_variables(tx.clean_line(F.col("value"))).alias("masked")
    )


@query
def exact_templates(spark, sf_dir):
    return templates.exact_templates(
        _documents(spark, sf_dir).select(tx.clean_line(F.col("value")).alias("truncated_log"))
    )


def _mined(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    with passing_tables(spark):
        timed, untimed = document_records(spark, sf_dir)
        built = templates.with_shape_key(records.build_records(timed, untimed, as_of=AS_OF))
        built = materialize(built.select("record_id", "file_name", "truncated_log", "shape", "shape_key"), "records", keep=True)
    return templates.mine_templates(built)


@query
def mine_templates(spark, sf_dir):
    templated, _ = _mined(spark, sf_dir)
    return templated.select(
        "file_name", F.col("record_id.line_seq").alias("line_seq"), "template_id", "template"
    )


@query
def extract_templates(spark, sf_dir):
    _, mined = _mined(spark, sf_dir)
    return templates.extract_templates(mined)


@query
def event_templates(spark, sf_dir):
    mined = event_analysis(spark, sf_dir).templates
    return templates.extract_templates(mined)


@query
def event_store(spark, sf_dir):
    found = event_analysis(spark, sf_dir).template_table()
    return found.select(
        "template_id", "template", "var_count", "golden_signal", "occurrence_count", "component", "rep_log"
    )


@query
def event_template_rows(spark, sf_dir):
    return event_analysis(spark, sf_dir).templated.select(
        "file_name", F.col("record_id.line_seq").alias("line_seq"), "template_id", "template",
        F.to_json("variables").alias("variables"),
    )


@query
def template_variables(spark, sf_dir):
    templated, _ = _mined(spark, sf_dir)
    return templated.select(
        "template_id", masking.var_count(F.col("template")).alias("var_count"),
        F.to_json("variables").alias("variables"),
    )


@query
def extract_variables(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    template = F.when(F.col("template_id") % 2 == 0, F.lit("<*> <*> x <*>")).otherwise(F.col("template"))
    return rows.select(
        F.col("record_id.line_seq").alias("event_id"),
        F.array_join(masking.extract_variables(F.col("text"), template), "|").alias("variables"),
        masking.var_count(template).alias("var_count"),
    )


@query
def match_templates(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    known = templates.mine_shapes(templates.distinct_shapes(rows, "text"))[1]
    matched = templates.match_templates(rows.drop("template_id", "template"), known, "text")
    return matched.join(known.select("template_id", "template"), "template_id", "left").select(
        F.col("record_id.line_seq").alias("event_id"), "template"
    )


# --- tags and labels ------------------------------------------------------------


def _tag_lines(spark, sf_dir) -> DataFrame:
    return tables.event_lines(spark, sf_dir).select(
        F.struct(
            F.lit(0).alias("section"), "file_name", "block_start", "line_seq"
        ).alias("record_id"),
        F.col("value").alias("text"),
        F.pmod(F.length("value"), F.lit(50)).cast("long").alias("template_id"),
    )


@query
def component_totals(spark, sf_dir):
    """The tag rules come from a file."""
    path = f"{shared_dir(spark)}/tags-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(TAGS),)], "value string").coalesce(1).write.text(path)
    found = tags.template_components(_tag_lines(spark, sf_dir), tags.load_tags(spark, path))
    return tags.distinct_components(found)


@query
def component_tags(spark, sf_dir):
    lines = _tag_lines(spark, sf_dir)
    return tags.tag_components(lines, TAGS).select(
        F.col("record_id.line_seq").alias("line_seq"), "template_id", "component"
    )


@query
def match_tag(spark, sf_dir):
    lines = tables.event_lines(spark, sf_dir)
    tag = tk.match_tag(
        tk.bracket_tokens(F.col("value")), F.col("value"), TAGS["tags"], TAGS["default_tag"]
    )
    return lines.select("line_seq", tag.alias("tag"))


@query
def representatives(spark, sf_dir):
    return classify.representatives(labelled_events(spark, sf_dir)).select(
        "template_id", "file_name", "n", "text", "ts_text", "rep_text"
    )


@query
def classify_rules(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("rep_text", F.lower(tx.clean_line(F.col("value"))))
    scored = classify.classify_rules(docs, classify.SIGNAL_WORDS)
    best = F.element_at("scored", 1)
    return scored.select(
        "file_name", "line_seq", best["label"].alias("label"), F.round(best["score"], 6).alias("score")
    )


def _length_model():
    """A stand-in model: label by text length, one call per batch."""
    def predict(texts):
        return [
            [("latency", 0.75), ("error", 0.25)] if len(t) % 2 else [("error", 0.625), ("latency", 0.375)]
            for t in texts
        ]

    return predict


@query
def classify_callable(spark, sf_dir):
    reps = classify.representatives(labelled_events(spark, sf_dir))
    scored = classify.classify_callable(reps, _length_model)
    return scored.select(
        "template_id", "file_name", classify.top_label(F.col("scored")).alias("label"),
        F.element_at("scored", 1)["score"].alias("score"),
    )


@query
def fault_categories(spark, sf_dir):
    reps = classify.representatives(labelled_events(spark, sf_dir))
    labelled = classify.label_representatives(reps)
    return labelled.select(
        "template_id", "file_name", "golden_signal", F.round("score", 6).alias("score"),
        F.array_join("fault_categories", ",").alias("faults"),
    )


def _labelled_reps(spark, sf_dir) -> DataFrame:
    return classify.label_representatives(classify.representatives(labelled_events(spark, sf_dir)))


@query
def signal_spread(spark, sf_dir):
    rows = labelled_events(spark, sf_dir).drop("golden_signal", "fault_categories")
    return classify.spread_signals(rows, _labelled_reps(spark, sf_dir)).select(
        F.col("record_id.line_seq").alias("event_id"), "golden_signal", "error_tid",
        F.array_join("fault_categories", ",").alias("faults"),
    )


@query
def non_info(spark, sf_dir):
    return classify.non_info(labelled_events(spark, sf_dir)).select(
        F.col("record_id.line_seq").alias("event_id"), "golden_signal"
    )


@query
def weighted_vote(spark, sf_dir):
    scores = tables.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("template_id"), F.col("event_type").alias("label"),
        F.floor("value").cast("double").alias("score"),
    )
    return classify.weighted_vote(scores, "template_id").withColumn(
        "mean_score", F.round("mean_score", 6)
    )


@query
def template_signal_vote(spark, sf_dir):
    """Templates are folded to five, so that each gets votes for several signals."""
    reps = _labelled_reps(spark, sf_dir)
    return classify.vote_signal(reps.withColumn("template_id", F.col("template_id") % 5))


@query
def signal_distribution(spark, sf_dir):
    return classify.signal_distribution(_labelled_reps(spark, sf_dir))


# --- windows ----------------------------------------------------------------------


def _windows(spark, sf_dir) -> DataFrame:
    return windows.tumbling_windows(labelled_events(spark, sf_dir), SECONDS)


def _ids(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), " ")


@query
def tumbling_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        "win", micros(F.col("epoch")).alias("epoch_us"), "n", "all_info",
        _ids("tids").alias("tids"), _ids("error_tids").alias("error_tids"),
    )


@query
def normal_windows(spark, sf_dir):
    return windows.normal_windows(_windows(spark, sf_dir), SECONDS).withColumn("tids", _ids("tids"))


@query
def event_windows(spark, sf_dir):
    found = event_analysis(spark, sf_dir).windows
    return found.select(
        "win", micros(F.col("epoch")).alias("epoch_us"), "n", "all_info", _ids("error_tids").alias("error_tids")
    )


@query
def normal_window_lines(spark, sf_dir):
    """Windows of 30 seconds."""
    labelled = labelled_events(spark, sf_dir)
    found = materialize(windows.tumbling_windows(labelled), "windows")
    return windows.normal_window_lines(labelled, found).select(
        "win", "start_ts", "end_ts", F.col("record_id.line_seq").alias("event_id"), "template_id", "text"
    )


@query
def window_counts(spark, sf_dir):
    return windows.window_counts(_windows(spark, sf_dir))


def _merged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return windows.merge_windows(materialize(_windows(spark, sf_dir), "windows"), SECONDS)


@query
def merge_windows(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("win", "root_id")


@query
def anomalies(spark, sf_dir):
    return windows.anomalies(_merged(spark, sf_dir)[0]).drop("start_epoch", "end_epoch").withColumn(
        "error_tids", _ids("error_tids")
    )


def _anomaly_items(spark, sf_dir) -> DataFrame:
    labelled = labelled_events(spark, sf_dir)
    found = materialize(windows.tumbling_windows(labelled), "windows")
    merged, placed = windows.merge_windows(found)
    return windows.anomaly_items(labelled, placed, merged)


@query
def anomaly_items(spark, sf_dir):
    return _anomaly_items(spark, sf_dir).select(
        F.col("record_id.line_seq").alias("event_id"), "win", "root_id", "text_output",
        micros(F.col("start_epoch")).alias("start_us"), micros(F.col("end_epoch")).alias("end_us"),
    )


@query
def anomaly_documents(spark, sf_dir):
    documents = windows.anomaly_documents(_anomaly_items(spark, sf_dir))
    items = F.arrays_zip("logs", "files", "gs", "templateIds")
    return documents.select("root_id", "duration", F.explode(items).alias("i")).select(
        "root_id", "duration", "i.logs", "i.files", "i.gs", "i.templateIds"
    )


def _preview_query(name: str, unique: bool, coloured: bool, count: int | None) -> None:
    def run(spark, sf_dir):
        items = windows.window_items(labelled_events(spark, sf_dir), 6 * 3600)
        shown = windows.window_preview(items, unique, coloured, count)
        return shown.select("win", F.col("record_id.line_seq").alias("event_id"), "template_id", "text")

    run.__name__ = name
    query(run)


_preview_query("window_preview", True, True, 5)
_preview_query("window_preview_signals", False, True, 5)
_preview_query("window_preview_unique", True, False, 5)
_preview_query("window_preview_all", True, True, None)


# --- summary, timeline --------------------------------------------------------------


@query
def template_summary(spark, sf_dir):
    return event_analysis(spark, sf_dir).summary().withColumnRenamed("gs", "golden_signal")


def _summary(spark, sf_dir) -> DataFrame:
    return summary.template_summary(labelled_events(spark, sf_dir))


@query
def summary_table(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def summary_filter(spark, sf_dir):
    return summary.filter_summary(_summary(spark, sf_dir), "Latency", "app-3.log", "ABOVE response")


@query
def stat_cards(spark, sf_dir):
    return summary.stat_cards(_summary(spark, sf_dir))


@query
def file_choices(spark, sf_dir):
    return summary.file_choices(_summary(spark, sf_dir))


@query
def analysis_result(spark, sf_dir):
    reps = materialize(classify.representatives(labelled_events(spark, sf_dir)), "reps")
    return summary.analysis_result(reps, classify.label_representatives(reps))


@query
def analysis_totals(spark, sf_dir):
    return summary.analysis_totals(_labelled_reps(spark, sf_dir))


@query
def signal_timeline(spark, sf_dir):
    found = timeline.signal_timeline(labelled_events(spark, sf_dir))
    return found.withColumn("bin_start", micros(F.col("bin_start")))


@query
def timeline_documents(spark, sf_dir):
    found = timeline.timeline_documents(timeline.signal_timeline(labelled_events(spark, sf_dir)))
    return found.select(
        "file_name", "bin_seconds", F.size("bins").cast("long").alias("bins"),
        F.aggregate(
            "bins", F.lit(0).cast("long"),
            lambda acc, b: acc + F.aggregate(b["counts"], F.lit(0).cast("long"), lambda x, y: x + y["count"]),
        ).alias("records"),
    )


@query
def temporal_evolution(spark, sf_dir):
    found = timeline.temporal_evolution(labelled_events(spark, sf_dir))
    return found.withColumn("start_epoch", micros(F.col("start_epoch")))


# --- causality ------------------------------------------------------------------------


def _series(spark, sf_dir) -> DataFrame:
    return causality.template_series(labelled_events(spark, sf_dir))


@query
def template_series(spark, sf_dir):
    return _series(spark, sf_dir).select(
        "template_id", F.posexplode("values").alias("k", "count")
    ).where("count > 0")


@query
def series_diff(spark, sf_dir):
    return causality.differenced(_series(spark, sf_dir)).select(
        "template_id", F.posexplode("diffs").alias("k", "diff")
    ).where("diff <> 0")


def _hourly_series(spark, sf_dir) -> DataFrame:
    return materialize(_series(spark, sf_dir), "hourly")


@query
def granger_pairs(spark, sf_dir):
    pairs = causality.granger_pairs(causality.differenced(_hourly_series(spark, sf_dir)))
    return pairs.select(
        "first_id", "second_id", F.round("min_p", 6).alias("min_p"),
        F.array_join(F.transform("p_values", lambda p: F.format_string("%.4f", p)), " ").alias("p_values"),
    )


@query
def causal_graph(spark, sf_dir):
    pairs = materialize(
        causality.granger_pairs(causality.differenced(_hourly_series(spark, sf_dir))), "pairs"
    )
    labels = labelled_events(spark, sf_dir).groupBy("template_id").agg(F.min_by("text", "record_id").alias("rep_log"), F.min("golden_signal").alias("golden_signal"))
    nodes, edges = causality.causal_graph(pairs, labels)
    return edges.join(nodes.withColumnRenamed("id", "source"), "source").select(
        "source", "target", "label", "gs"
    )


# --- store and explorer -----------------------------------------------------------------


@query
def log_store_templates(spark, sf_dir):
    rows = labelled_events(spark, sf_dir).withColumn("component", F.lit("Web"))
    return store.template_table(rows, _labelled_reps(spark, sf_dir))


@query
def template_file_maps(spark, sf_dir):
    """Three files to a map, so that the templates need several."""
    maps = store.template_file_maps(store.template_files(labelled_events(spark, sf_dir)), per_map=3)
    entries = F.transform(F.map_entries("file_sources"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.withColumn("file_sources", F.array_join(entries, ","))


@query
def template_files(spark, sf_dir):
    return store.template_files(labelled_events(spark, sf_dir))


@query
def log_store_entries(spark, sf_dir):
    found = store.log_entries(labelled_events(spark, sf_dir), dense=True)
    return found.withColumn("variables", F.to_json("variables"))


@query
def log_store_day(spark, sf_dir):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = labelled_events(spark, sf_dir)
    reps = _labelled_reps(spark, sf_dir)
    sinks.write_store(
        store.template_table(rows, reps), store.template_files(rows), store.log_entries(rows), path
    )
    entries = sinks.read_entries(spark, path).where(F.col("day") == F.lit("2024-01-10"))
    return entries.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("latest")
    )


@query
def store_totals(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    return store.store_totals(
        store.template_table(rows, _labelled_reps(spark, sf_dir)), store.log_entries(rows)
    )


def _entries(spark, sf_dir) -> DataFrame:
    rows = labelled_events(spark, sf_dir)
    found = store.template_table(
        rows.withColumn("component", F.lit("Web")), _labelled_reps(spark, sf_dir)
    )
    return explore.with_templates(store.log_entries(rows), found)


@query
def explore_facets(spark, sf_dir):
    return explore.facets(_entries(spark, sf_dir), ["golden_signal", "file_source", "fault_category"])


@query
def explore_search(spark, sf_dir):
    found = explore.search_entries(
        _entries(spark, sf_dir), "LATENCY", ["Latency"], ["app-1.log", "app-2.log"]
    )
    return found.select("template_id", "timestamp", "file_source", "original_text")


@query
def explore_variable(spark, sf_dir):
    found = explore.search_entries(_entries(spark, sf_dir), template_id=2017, variable="17")
    return found.select("template_id", "timestamp", "file_source", "original_text")


@query
def explore_templates(spark, sf_dir):
    rows = labelled_events(spark, sf_dir)
    found = store.template_table(rows, _labelled_reps(spark, sf_dir))
    return explore.search_templates(found, "disk", ["saturation"]).select(
        "template_id", "template", "occurrence_count"
    )


@query
def explore_page(spark, sf_dir):
    entries = store.log_entries(labelled_events(spark, sf_dir)).withColumn(
        "entry_id", F.col("entry_id.line_seq")
    )
    first_of_day = int(datetime(2024, 1, 20, tzinfo=timezone.utc).timestamp())
    found = explore.page(entries, 100, after=(first_of_day, "", -1))
    return found.select("entry_id", "template_id", "timestamp", "file_source", "original_text")


@query
def matched_interval(spark, sf_dir):
    rows = labelled_events(spark, sf_dir).select(
        F.col("text").alias("truncated_text"), "epoch", F.col("record_id.line_seq").alias("row_id")
    )
    ids = rows.groupBy("truncated_text").agg(F.min("row_id").alias("test_ids"))
    train = rows.groupBy("truncated_text").agg(F.max("row_id").alias("train_ids"))
    matched = matcher.matched_rows(rows, ids, train)
    start = datetime(2024, 1, 5, tzinfo=timezone.utc).timestamp()
    return records.interval_filter(matched, start, 10 * 86400).select(
        "row_id", "test_ids", "train_ids", "truncated_text", "format"
    )


@query
def matcher_files(spark, sf_dir):
    path = f"{shared_dir(spark)}/matcher-{uuid.uuid4().hex}"
    pairs = labelled_events(spark, sf_dir).groupBy("text").agg(F.min("template_id").alias("id"))
    # Files of one JSON object each, of about a hundred lines.
    size = pairs.agg(F.ceil(F.count(F.lit(1)) / 100).alias("files"))
    objects = (
        pairs.crossJoin(F.broadcast(size))
        .groupBy(F.pmod(F.xxhash64("text"), F.col("files")).alias("part"))
        .agg(F.map_from_entries(F.collect_list(F.struct("text", "id"))).alias("m"))
    )
    (
        objects.select(F.to_json("m").alias("value"))
        .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    )
    return matcher.read_matcher_files(spark, path, "test_ids", "*.txt")


def _chunked_lines(spark, sf_dir, limit: int) -> DataFrame:
    rows = tables.document_lines(spark, sf_dir).select("file_name", "line_seq", "value")
    return sinks.chunk_by_bytes(rows, ["file_name", "line_seq"], limit, F.octet_length("value") + 1)


@query
def chunk_by_bytes(spark, sf_dir):
    """Chunks small enough that many rows stand alone."""
    chunked = _chunked_lines(spark, sf_dir, 1024)
    return chunked.select("file_name", "line_seq", "chunk.*", F.col("row_bytes").cast("long").alias("row_bytes"))


@query
def chunk_files(spark, sf_dir):
    """The chunks written as JSON files of one folder each, and read back."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunked = _chunked_lines(spark, sf_dir, 64 * 1024)
    name = F.concat_ws("-", F.col("chunk.after").cast("string"), F.col("chunk.alone").cast("int").cast("string"), F.col("chunk.piece").cast("string"))
    line = F.to_json(F.struct("file_name", "line_seq", "value"))
    sinks.write_chunk_folders(chunked.withColumn("part", name), path, line, ["file_name", "line_seq"], "json")
    back = spark.read.schema("file_name string, line_seq long, value string, part string").json(path)
    return back.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max(F.sha2(F.concat_ws("|", "file_name", F.col("line_seq").cast("string"), "value"), 256)).alias("largest"),
    )


@query
def report_size(spark, sf_dir):
    return sinks.report_size(sinks.chunk_sizes(_chunked_lines(spark, sf_dir, 64 * 1024)))


@query
def run_metrics(spark, sf_dir):
    """The figures come from the passes that write the lines; the times differ from run to run."""
    run = sinks.RunMetrics()
    blank = F.count_if(F.regexp_replace("value", r"\s+", "") == "")
    with run.stage("lines"):
        lines = tables.document_lines(spark, sf_dir)
        materialize(run.observed(lines, num_log_lines_total=F.count(F.lit(1)), num_log_lines_whitespaces=blank), "lines")
    for _ in range(2):
        with run.stage("events"):
            events = tables.table(spark, sf_dir, "events")
            materialize(run.observed(events, num_log_lines_processed=F.count(F.lit(1))), "events")
    return run.rows(spark).where("name NOT LIKE '%_time_ms'")


def _reported(documents: DataFrame, order: list[str], limit: int) -> DataFrame:
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(documents, folder, order, limit)
    return reports.read_report(spark, folder).select("part", F.col("value").alias("document"))


@query
def report_templates(spark, sf_dir):
    """The template table as report files, read back."""
    rows = labelled_events(spark, sf_dir).withColumn("component", F.lit("Web"))
    found = store.template_table(rows, _labelled_reps(spark, sf_dir))
    document = F.to_json(F.struct(
        "template_id", "template", "golden_signal", "fault_category", "occurrence_count", "component", "rep_log"
    ))
    return _reported(found.select("template_id", document.alias("document")), ["template_id"], 4096)


@query
def report_timeline(spark, sf_dir):
    """The timeline of each file as a document, read back."""
    found = timeline.timeline_documents(timeline.signal_timeline(labelled_events(spark, sf_dir)))
    bins = F.transform("bins", lambda b: F.struct(b["bin_idx"].alias("bin_idx"), b["label"].alias("label"), b["counts"].alias("counts")))
    document = F.to_json(F.struct("file_name", "bin_seconds", "bin_name", bins.alias("bins")))
    return _reported(found.select("file_name", document.alias("document")), ["file_name"], 64 * 1024)


@query
def report_anomalies(spark, sf_dir):
    """The pieces of the anomalies as report files, read back."""
    found = windows.anomaly_documents(_anomaly_items(spark, sf_dir), 16 * 1024)
    document = F.to_json(F.struct("root_id", "duration", "logs", "files", "gs", "templateIds"))
    return _reported(
        found.select("root_id", F.col("chunk").alias("piece"), document.alias("document")), ["root_id", "piece"], 64 * 1024
    )


@query
def input_stats(spark, sf_dir):
    return ln.input_stats(spark, [_text_files(spark, sf_dir)])
