"""Sinks: the store, reports, debug outputs, size-bounded chunks, run metrics."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from logtide.plans.common import join_by_key, running_sums

PART_ENTRIES = 1_000_000  # entries of an hour that one file of the store holds
CHUNK_BYTES = int(2.5 * 1024 * 1024)  # fixed value: report chunks stay below this


def write_store(templates: DataFrame, files: DataFrame, entries: DataFrame, path: str) -> None:
    """Templates, their file counts, and entries by day, newest first in each file."""
    templates.write.mode("overwrite").parquet(f"{path}/templates")
    files.write.mode("overwrite").parquet(f"{path}/template_files")
    day = F.to_date(F.timestamp_seconds("timestamp"))
    # Days are uneven, so rows spread over each day's hours, and those of an hour over as many parts as it needs.
    hour = F.floor(F.col("timestamp") / 3600)
    hours = entries.groupBy(hour.alias("_hour")).agg(F.ceil(F.count(F.lit(1)) / PART_ENTRIES).alias("_parts"))
    (
        join_by_key(entries.withColumns({"day": day, "_hour": hour}), hours, ["_hour"])
        .repartition("day", "_hour", F.pmod(F.xxhash64("entry_id"), F.col("_parts"))).drop("_hour", "_parts")
        .sortWithinPartitions("day", F.desc("timestamp"), "file_source", "entry_id")
        .write.mode("overwrite").partitionBy("day").parquet(f"{path}/log_entries")
    )


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log_entries")


def write_unquoted_csv(df: DataFrame, path: str) -> None:
    """CSV without quotes, one record per line: backslash, comma and line ends
    are escaped by a backslash."""
    def escaped(name: str):
        text = F.regexp_replace(F.col(name), r"([\\,])", r"\\$1")
        for char, letter in (("\n", "n"), ("\r", "r")):
            text = F.regexp_replace(text, char, rf"\\{letter}")
        return text

    columns = [escaped(c) if t == "string" else F.col(c).cast("string") for c, t in df.dtypes]
    lines = df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in columns]).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_debug(
    path: str, untimed: DataFrame, discarded: DataFrame, records: DataFrame, templated: DataFrame
) -> None:
    """Lines without time, refused JSON, processed rows, and the lines of each
    template as rows, so that no template's lines have to fit one value."""
    untimed.select("text").write.mode("overwrite").text(f"{path}/none_logs")
    discarded.select("value").write.mode("overwrite").text(f"{path}/json_discarded")
    write_unquoted_csv(records.drop("record_id"), f"{path}/processed_logs")
    templated.select("template_id", "truncated_log").write.mode("overwrite").json(
        f"{path}/matcher_output"
    )


def chunk_by_bytes(
    df: DataFrame, order: list[str], limit: int = CHUNK_BYTES, size: Column | None = None
) -> DataFrame:
    """Rows with their ``row_bytes`` and the ``chunk`` they fall in: runs in the given total
    order whose bytes never exceed limit.

    Rows above half the limit are chunks of their own; the others are cut each time the
    bytes of such rows pass another half. ``chunk`` is (rows above half before, alone, piece) and
    sorts like the rows. A row above the limit is a chunk above it. ``size`` is the
    bytes of a row, by default those of its JSON.
    """
    half = limit // 2
    sized = df.withColumn("row_bytes", size if size is not None else F.octet_length(F.to_json(F.struct(*df.columns))))
    alone = F.col("row_bytes") > half
    summed = running_sums(sized, [F.col(c) for c in order], {
        "_large": alone.cast("long"), "_small": F.when(alone, 0).otherwise(F.col("row_bytes")).cast("long"),
    })
    piece = F.when(alone, 0).otherwise(F.floor(F.col("_small") / half))
    chunk = F.struct(F.col("_large").alias("after"), alone.alias("alone"), piece.cast("long").alias("piece"))
    return summed.withColumn("chunk", chunk).drop("_large", "_small")


def chunk_sizes(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_bytes").alias("bytes"))


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as the machines' own or mounted folder, None where it lies in another store."""
    if path.startswith("/"):
        path = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").rstrip("/") + path
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else None


def write_chunk_folders(rows: DataFrame, path: str, line: Column, order: list[str], kind: str) -> None:
    """A folder ``part=...`` for each ``part`` of the rows, with one file of their lines in the given order.

    ``kind`` ends the files' names; parts are names without marks but hyphens. A part is written
    by one task, so it has to be small. In folders of the machines the tasks write the files: Hadoop's file
    system would start a process for each file, folder and checksum to set its mode, which takes
    many times as long as the lines of a small chunk. A file gets its name once it is whole, so tasks can be
    repeated. Other stores get them from Spark's writer.
    """
    dealt = rows.repartition("part").sortWithinPartitions("part", *order)
    lines = dealt.select("part", line.alias("value"))  # rendered here, so the shuffle carries no text twice
    folder = _local_folder(rows.sparkSession, path)
    if folder is None:
        lines.write.partitionBy("part").text(path)
        return

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, file, count = f".{uuid.uuid4().hex}", None, None, 0

        def close() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, f"{folder}/part={part}/part-0.{kind}")

        for batch in batches:
            values = batch["value"].cast(pa.large_binary())
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :]
            data = memoryview(values.buffers()[2] or b"")
            runs, start = pc.run_end_encode(batch["part"]), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != part:
                    close()
                    part = name
                    os.makedirs(f"{folder}/part={part}", exist_ok=True)
                    file = open(f"{folder}/part={part}/{own}", "wb")
                file.write(data[offsets[start] : offsets[end]])
                start = end
            count += batch.num_rows
        close()
        yield pa.RecordBatch.from_pydict({"rows": pa.array([count], pa.int64())})

    os.makedirs(folder, exist_ok=True)
    ended = lines.select("part", F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value"))
    ended.mapInArrow(written, "rows long").agg(F.sum("rows")).collect()


def report_size(sizes: DataFrame) -> DataFrame:
    """One row: chunks and rows in them."""
    return sizes.agg(F.count(F.lit(1)).alias("no_of_chunks"), F.sum("rows").alias("no_of_windows"))


def merge_metrics(*stages: DataFrame) -> DataFrame:
    """Named values of all stages; times of one name are summed."""
    merged = stages[0]
    for stage in stages[1:]:
        merged = merged.unionByName(stage)
    return merged.groupBy("name").agg(F.sum("value").alias("value"))


def as_metrics(row: DataFrame) -> DataFrame:
    """A one-row frame as (name, value) rows."""
    return row.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns
        ])).alias("m")
    ).select("m.name", "m.value")


class RunMetrics:
    """Figures of a run, taken in the passes that write its tables, and the time its stages take."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []
        self._times: list[tuple[str, float]] = []

    def observed(self, df: DataFrame, **figures: Column) -> DataFrame:
        """df, whose next write or other action gives these aggregates as figures of the run."""
        self._seen.append(Observation())
        return df.observe(self._seen[-1], *[c.alias(name) for name, c in figures.items()])

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.monotonic()
        try:
            yield
        finally:
            self._times.append((f"{name}_time_ms", (time.monotonic() - start) * 1000))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(name, value): figures and times of one name are summed. All that is observed must have been run."""
        found = [(k, float(v or 0)) for seen in self._seen for k, v in seen.get.items()]
        return spark.createDataFrame([*found, *self._times], "name string, value double").groupBy("name").agg(
            F.sum("value").alias("value")
        )
