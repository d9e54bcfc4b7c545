"""Token ids as Parquet list columns, for selective reads of ids or metadata.

A file holds a range of documents in ascending doc_id order. The ids are one list
column, dictionary or delta encoded; row groups and pages have a bounded size, and
the writer adds column and offset indexes, so a reader of a few documents fetches
their pages alone, and a reader of doc_id and n_tokens no ids at all.

Cases: a null text is an empty one and gives the end id alone. Null doc_ids come
first. Rows with the same doc_id follow one another, by a hash of their text. An
empty table gives no rows. Other columns are ignored. A text of any length is one list.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logtide.llm.texts import TextEncoder, blocks, id_and_text, tokenizer_path, worker_kept
from logtide.plans.common import shared_dir

FILE_SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    keeps_space: bool = True,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode every text and write the ids in ascending doc_id order.

    The texts are dealt by range before they are encoded, so that the sampling of
    ranges encodes nothing.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    path = path or tokenizer_path("byte_bpe_50k.json")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = worker_kept(("encoder", path, keeps_space), lambda: TextEncoder(path, keeps_space))
        row = 0
        part = TaskContext.get().partitionId()
        for batch in blocks(batches):
            ids, sizes = encode.arrays(batch["text"])
            values = np.insert(ids, np.cumsum(sizes), end_id).view(np.int32)
            sizes, count = sizes + 1, batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, part, np.int32)), pa.array(np.arange(row, row + count)),
                    batch["doc_id"], pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values)),
                ],
                ["part", "row", "doc_id", "n_tokens", "ids"],
            )
            row += count

    order = [F.col("doc_id"), F.xxhash64("text")]
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    ordered = id_and_text(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(encoded, FILE_SCHEMA).write.options(**options).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The written rows; columns and pages that a query doesn't need are not read."""
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def token_ranges(tokens: DataFrame) -> DataFrame:
    """Per document, from the lists read: start (ids of all documents before it), n_tokens and the ids' crc32."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 16 << 20):
            lists = batch["ids"]
            bounds = lists.offsets.to_pylist()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sizes = [b - a for a, b in zip(bounds, bounds[1:])]
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["part"], batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("part", "row", "doc_id", "ids").mapInArrow(
        measured, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"
    )
    # One row per file, at most as many as there are shuffle partitions; the lists are not read for it.
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("start"),
        "n_tokens", "ids_crc32",
    )


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of all documents to the shared folder and measure what is read back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, **options)
    return token_ranges(read_tokens(spark, folder))
