"""Text log sources: file selection, line scans, file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names taken from folders and archives; a rotation number may
# follow the extension directly, after ".-", or after ".".
LOG_NAME = r"^.+\.log(\.-?)?\d*$"
TXT_NAME = r"^.+\.txt(\.-?)?\d*$"


def name_selected(name: Column, all_files: bool, log_files: bool, txt_files: bool) -> Column:
    """Whether a file found in a folder or archive is processed."""
    if all_files:
        return F.lit(True)
    wanted = F.lit(False)
    if log_files:
        wanted = wanted | name.rlike(LOG_NAME)
    if txt_files:
        wanted = wanted | name.rlike(TXT_NAME)
    return wanted


def named_file_selected(name: Column, csv_enabled: bool = False) -> Column:
    """Whether a file given by name is processed: markup and sheets are not.

    Every suffix of the name counts, so ``a.xml.bak`` is refused as well.
    """
    refused = ["xml", "tsv"] + ([] if csv_enabled else ["csv", "xlsx"])
    parts = F.split(F.ltrim(name, F.lit(".")), r"\.")
    suffixes = F.slice(parts, F.lit(2), F.size(parts))
    return ~F.arrays_overlap(suffixes, F.array(*map(F.lit, refused)))


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, length of every file below the folders; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")
        .dropDuplicates(["path"])
    )


def select_files(
    files: DataFrame, all_files: bool = False, log_files: bool = True, txt_files: bool = False
) -> DataFrame:
    """The file table with a ``processed`` flag; unflagged rows are the ignored list."""
    return files.withColumn(
        "processed", name_selected(F.col("name"), all_files, log_files, txt_files)
    )


def read_log_lines(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    """One row per physical line, with its place in its file.

    Files are split between tasks; within a block ``line_seq`` grows, and blocks
    are ordered by ``block_start``.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(sorted(set(paths))).select(
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_seq"),
        "value",
    )


def file_stats(lines: DataFrame) -> DataFrame:
    """Lines and whitespace-only lines per file."""
    return lines.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("num_lines"),
        F.count_if(F.regexp_replace("value", r"\s+", "") == "").alias("num_blank"),
    )


def input_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row: bytes, lines and whitespace-only lines of all files.

    Sizes come from the file listing, line counts from the scan.
    """
    sizes = list_files(spark, paths).agg(F.sum("length").alias("total_size_bytes"))
    counts = file_stats(read_log_lines(spark, paths)).agg(
        F.sum("num_lines").alias("num_log_lines_total"),
        F.sum("num_blank").alias("num_log_lines_whitespaces"),
    )
    return sizes.crossJoin(counts)
