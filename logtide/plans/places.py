"""The first record of a group without sorting records.

A record's place in its file is one number, which a hash aggregate holds in its buffer: the first
place per group is found on narrow rows, and one join fetches the texts of the records that stand
there. Beyond a count of places, a bitmap of fixed size keeps most other records out of its shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from logtide.plans.common import materialize

FEW = 100_000  # places up to which the planner is left to broadcast them
BITS = 1 << 28  # of the bitmap: 32 MB at most, whatever the data
_PAGE = 1 << 15  # bits that one row of the bitmap holds
_SECTION, _BLOCK = 10**36, 10**19


def place_in_file(record_id: str = "record_id") -> Column:
    """Section, block and line of a record id as one number that sorts like them.

    Room for blocks up to 10^17 bytes into a file; beyond it the sum is refused, not wrong.
    """
    return F.expr(
        f"CAST({record_id}.section AS decimal(1,0)) * {_SECTION}BD"
        f" + CAST({record_id}.block_start + 1 AS decimal(17,0)) * {_BLOCK}BD"
        f" + CAST(CAST({record_id}.line_seq AS decimal(20,0)) + 1 AS decimal(20,0))"
    )


def place_order(file_name: str, place: str) -> Column:
    """A struct that sorts places of several files like their record ids."""
    section = F.expr(f"CAST({place} div {_SECTION}BD AS int)")
    return F.struct(section.alias("section"), F.col(file_name).alias("file_name"), F.col(place).alias("place"))


def likely_in(rows: DataFrame, table: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The rows whose keys stand in the table, and a few others: a bitmap of the keys' hashes."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    pages = table.select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {_PAGE}").alias("_page")).agg(
        F.bitmap_construct_agg(F.expr(f"_bit % {_PAGE}")).alias("_map")
    )
    byte = f"substr(_map, CAST((_bit % {_PAGE}) div 8 AS int) + 1, 1)"
    hit = F.expr(f"getbit(CAST(conv(hex({byte}), 16, 10) AS bigint), CAST(_bit % 8 AS int)) = 1")
    marked = rows.withColumn("_bit", bit).withColumn("_page", F.expr(f"_bit div {_PAGE}"))
    return marked.join(F.broadcast(pages), "_page").where(hit).select(*rows.columns)


def records_at(records: DataFrame, places: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """Each row of ``places`` (written, keys unique) with the columns of the record that stands there."""
    others = [c for c in places.columns if c not in keys]
    records = records.drop(*others)
    if places.count() > few:
        records = likely_in(records, places, keys)
    at = {key: f"_at{n}" for n, key in enumerate(keys)}
    # Keys may be null; a null is a group of its own.
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(name)) for key, name in at.items()])
    return records.join(places.withColumnsRenamed(at), same).select(*records.columns, *others)


def first_records(records: DataFrame, keys: list[str], columns: list[str], few: int = FEW) -> DataFrame:
    """Per group of ``keys``: ``n`` records and the columns of the first, by ``record_id``."""
    placed = records.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("record_id.file_name").alias("_file"),
        place_in_file().alias("_place"), *[F.col(c).alias(f"_of{i}") for i, c in enumerate(columns)],
    )
    names = [f"_key{i}" for i in range(len(keys))]
    found = placed.groupBy(*names, "_file").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("n"))
    if "file_name" not in keys:
        found = found.groupBy(*names).agg(
            F.min(place_order("_file", "_place")).alias("_first"), F.sum("n").alias("n")
        ).select(*names, F.col("_first.file_name").alias("_file"), F.col("_first.place").alias("_place"), "n")
    rows = records_at(placed, materialize(found, "first-places"), [*names, "_file", "_place"], few)
    return rows.select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "n",
        *[F.col(f"_of{i}").alias(c) for i, c in enumerate(columns)],
    )
