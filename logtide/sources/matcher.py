"""Matcher files and processed rows, read back and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logtide.plans.common import join_by_key


def read_unquoted_csv(
    spark: SparkSession, path: str, schema: str, columns: list[str] | None = None,
    header: bool = False,
) -> DataFrame:
    """CSV without quotes, one record per line, special characters escaped by a
    backslash (``\\n`` for a newline). The CSV reader takes escapes inside quotes
    only, so the fields are cut here."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.text(path)
    if header:
        lines = lines.where(F.col("value") != ",".join(f.name for f in fields))
    cut = F.regexp_extract_all(
        F.concat("value", F.lit(",")), F.lit(r"((?:[^\\,]|\\.)*+),"), F.lit(1)
    )

    def plain(field):
        for pattern, to in ((r"\\\\", "\x01"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\(.)", "$1"), ("\x01", r"\\")):
            field = F.regexp_replace(field, pattern, to)
        return field

    df = lines.withColumn("f", cut).select(*[
        plain(F.get("f", F.lit(i))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)
    ])
    return df.select(*columns) if columns else df


def read_matcher_files(
    spark: SparkSession, path: str, id_name: str, glob: str = "*.json"
) -> DataFrame:
    """Distinct (truncated_text, id) pairs of JSON files that map a line to an id."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,bigint>"))
    return whole.select(pairs.alias("truncated_text", id_name)).dropDuplicates()


def matched_rows(
    processed: DataFrame, test_ids: DataFrame, train_ids: DataFrame | None = None
) -> DataFrame:
    """Processed rows with the ids mined for their text, in time order.

    ``processed`` has truncated_text and a unique row_id.
    """
    for ids in (test_ids, train_ids):
        if ids is not None:
            rows = processed.groupBy("truncated_text").agg(F.count(F.lit(1)).alias("n"))
            per_id = ids.join(rows, "truncated_text")
            name = [c for c in ids.columns if c != "truncated_text"][0]
            # A text may have several ids; the join keeps one row per text and
            # the ids are spread after it.
            keyed = per_id.groupBy("truncated_text").agg(
                F.max("n").alias("n"), F.sort_array(F.collect_set(name)).alias("_ids")
            )
            processed = join_by_key(
                processed, keyed, ["truncated_text"], "n", "inner"
            ).withColumn(name, F.explode("_ids")).drop("_ids")
    return processed.withColumn("format", F.lit("%Y-%m-%d %H:%M:%S")).na.drop().orderBy("epoch", "row_id")
