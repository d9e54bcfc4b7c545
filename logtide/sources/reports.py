"""Report files: documents in chunks of bounded size, valid as a whole by a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.sources.sinks import CHUNK_BYTES, chunk_by_bytes, write_chunk_folders

MANIFEST = "part string, documents long, bytes long, digest long"


def _figures(rows: DataFrame) -> DataFrame:
    """What the manifest says of each part; the digest does not depend on the order."""
    return rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"),
        F.sum(F.pmod(F.xxhash64("value"), F.lit(1 << 40))).alias("digest"),
    )


def write_report(documents: DataFrame, folder: str, order: list[str], limit: int = CHUNK_BYTES) -> None:
    """One line per ``document``, a folder per chunk in the total order of ``order``, then the manifest.

    A chunk has at most ``limit`` bytes, or one document that is longer, so a task writes it as one
    file. Parts sort by name as the documents do. A folder without its manifest, or with files
    that don't agree with it, is not a report: a run that ends early leaves none.
    """
    chunked = chunk_by_bytes(
        documents.select(*order, F.col("document").alias("value")), order, limit, F.octet_length("value") + 1
    )
    name = F.concat_ws(
        "-", F.format_string("%012d", "chunk.after"), F.col("chunk.alone").cast("int").cast("string"),
        F.format_string("%012d", "chunk.piece"),
    )
    rows = chunked.withColumn("part", name)
    write_chunk_folders(rows, f"{folder}/documents", F.col("value"), order, "txt")
    _figures(rows.select("part", "value")).write.json(f"{folder}/manifest")


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """(part, value) of a report's documents; an error if they are not what the manifest says."""
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    if manifest.isEmpty():  # then there is no folder of documents
        return spark.createDataFrame([], "value string, part string")
    documents = spark.read.schema("value string, part string").text(f"{folder}/documents")
    found = _figures(documents)
    named = found.toDF("part", "_documents", "_bytes", "_digest")
    same = F.lit(True)
    for c in ("documents", "bytes", "digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = manifest.join(named, "part", "full").where(~same).select("part").limit(5).collect()
    if wrong:
        raise ValueError(f"{folder} differs from its manifest in parts {[r.part for r in wrong]}")
    return documents
