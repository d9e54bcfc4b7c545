"""Log lines derived from the supplied tables.

Each function renders table rows as the lines of named log files, so that every
operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MESSAGES = {
    "click": "request served from cache",
    "view": "response slow, latency above target",
    "purchase": "session started for user",
    "signup": "disk full on storage volume",
    "error": "connection failed with exception",
}
PART_ROWS = 100_000  # rows of a part at most, where a table is spread
DATE_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to render or read, spread over as many parts as its rows
    need, at least one per core. One whose splits hold even shares of them already stays as read:
    a file gives as many splits as its size allows, but its rows come in those where row groups begin."""
    df = table(spark, sf_dir, name)
    splits = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    rows, most = splits.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return df.repartition(parts) if most * parts > 2 * rows else df


def _message() -> Column:
    names = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("event"))


def _event_text() -> Column:
    return F.concat(
        F.date_format("ts", DATE_TEXT), F.lit(" ["), F.col("event_type"), F.lit("] app["),
        F.col("user_id").cast("string"), F.lit("]: "), _message(), F.lit(" value="),
        F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" props "), F.col("props"),
    )


def _place(file_name: Column, line_seq: Column) -> list[Column]:
    return [
        file_name.alias("file_name"), F.lit(0).cast("long").alias("block_start"),
        line_seq.cast("long").alias("line_seq"),
    ]


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timestamped line per event; errors are followed by two more lines."""
    more = F.when(
        F.col("event_type") == "error",
        F.array(
            _event_text(),
            F.concat(F.lit("  at frame "), (F.col("event_id") % 7).cast("string")),
            F.concat(F.lit("caused by code "), (F.col("user_id") % 13).cast("string")),
        ),
    ).otherwise(F.array(_event_text()))
    file_name = F.concat(F.lit("app-"), (F.col("user_id") % 8).cast("string"), F.lit(".log"))
    return spread_table(spark, sf_dir, "events").select(
        file_name.alias("file_name"), "event_id", F.posexplode(more).alias("pos", "value")
    ).select(*_place(F.col("file_name"), F.col("event_id") * 4 + F.col("pos")), "value")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents, one file per source; no timestamps."""
    return spread_table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".txt")).alias("file_name"), "doc_id",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"),
    ).select(*_place(F.col("file_name"), F.col("doc_id") * 100000 + F.col("pos")), "value")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flat, nested, broken and empty JSON, and as plain text."""
    kind = F.col("event_id") % 5
    text = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"))
    moment = F.date_format("ts", DATE_TEXT)
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    value = (
        F.when(kind == 0, F.concat(
            F.lit('{"time": "'), moment, F.lit('", "message": "'), text, F.lit('", "props": '),
            F.col("props"), F.lit("}")))
        .when(kind == 1, F.concat(
            F.lit('  {"meta": {"time": '), millis, F.lit('}, "body": {"message": "'), text,
            F.lit('", "deep": {"user": '), F.col("user_id").cast("string"), F.lit("}}}")))
        .when(kind == 2, F.concat(F.lit('{"time": "'), moment))
        .when(kind == 3, F.when(F.col("user_id") % 2 == 0, F.lit("{}")).otherwise(F.lit("[1, 2]")))
        .otherwise(F.concat(moment, F.lit(" "), text))
    )
    return spread_table(spark, sf_dir, "events").select(
        *_place(F.lit("events.json.log"), F.col("event_id")), value.alias("value")
    )


NESTED_TIME = "meta_event_time_of_the_source_system"
NESTED_MESSAGE = "log_a_b_c_d_e_f_g_h_i_j_k_message"


def nested_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects whose fields ``NESTED_TIME`` and ``NESTED_MESSAGE`` lie levels deep."""
    value = F.concat(
        F.lit('{"log": {"a_b": {"c_d": {"e_f_g_h_i_j_k_message": "'), F.col("event_type"), F.lit(" by user "),
        F.col("user_id").cast("string"), F.lit('"}}}, "meta": {"event_time": {"of_the_source": {"system": '),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string"), F.lit("}}}}"),
    )
    return spread_table(spark, sf_dir, "events").select(
        *_place(F.lit("nested.json.log"), F.col("event_id")), value.alias("value")
    )


def order_lines(spark: SparkSession, sf_dir: str, rendered: str) -> DataFrame:
    """One line per order. ``rendered`` is the SQL text of its date, given ``t``,
    the order's date plus its key as seconds of the day."""
    orders = spread_table(spark, sf_dir, "orders").withColumn(
        "t", F.expr("CAST(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    )
    return orders.select(
        *_place(F.lit("orders.log"), F.col("o_orderkey")),
        F.concat(F.expr(rendered), F.lit(" order "), F.col("o_orderstatus")).alias("value"),
    )
