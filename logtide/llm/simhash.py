"""SimHash near-duplicates with a pigeonring filter.

The 64 bits of a fingerprint form a ring of SEGMENTS equal parts (the last takes what is
left). If two fingerprints differ in at most t bits, some chain of consecutive parts
starts with at most l*t/m differences in its first l parts, for every l (Qin and
Xiao, Pigeonring, 2018). As long as l*t/m stays below one, these parts are equal: they
are the key that candidates share. The rest of the chain is tested on the pair, and only
what passes has its full Hamming distance taken.

Pairs are made of distinct fingerprints, so copies cost nothing. A key with more than
PAIRED fingerprints makes no pairs: within it every fingerprint meets, for each bit
outside the key, the value with that bit flipped; two fingerprints are at most two
bits apart exactly if they share such a value or one is such a value, and those that
share one are all linked through the smallest of them. Both ways find the same links.

Cases: a null text is an empty one; a text without words has fingerprint zero and links
like any other. Fewer words than a shingle's are one shingle. A component has the
smallest doc_id reachable; rows without doc_id count as the largest id. Rows that repeat
a doc_id are rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logtide.llm.components import components
from logtide.llm.texts import blocks, id_and_text
from logtide.plans.common import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
SEGMENTS = 5
PAIRED = 32  # fingerprints of a key that are compared in pairs
HASHES = 65_536  # shingle hashes held as bits at once


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    # On bytes, lower() changes A-Z alone and split() cuts at the six ASCII spaces.
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    width = min(words, len(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1]
    spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")
    return int(value[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) per row; text_key is a hash of the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            values = pa.array([fingerprint(t.as_py(), words) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], values], ["doc_id", "text_key", "fp"])

    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(made, "doc_id long, text_key long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(first: int, count: int, segments: int) -> int:
    """The bits of ``count`` consecutive segments of the ring, from ``first`` on."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    value = 0
    for i in range(first, first + count):
        low, high = bounds[i % segments], bounds[i % segments + 1]
        value |= (1 << high) - (1 << low)
    return value


def _exact_length(max_bits: int, segments: int) -> int:
    """Segments at the head of a chain that have to be equal: the largest l with l*t/m < 1."""
    return max(1, -(-segments // max_bits) - 1) if max_bits else segments


def _chain(first: int, max_bits: int, segments: int, differing: Column) -> Column:
    """Differences stay within their proportional budget all along the chain that starts at ``first``."""
    test = F.lit(True)
    for length in range(_exact_length(max_bits, segments) + 1, segments + 1):
        part = differing.bitwiseAND(F.lit(_signed(_mask(first, length, segments))))
        test = test & (F.bit_count(part) <= length * max_bits // segments)
    return test


def fingerprint_links(
    distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, paired: int = PAIRED
) -> DataFrame:
    """Links (a < b) whose transitive closure joins all fingerprints at most ``max_bits`` apart.

    ``distinct`` has the column fp, each value once, as a written table. Keys with
    more than ``paired`` fingerprints need max_bits <= 2.
    """
    if max_bits > 2:
        raise ValueError("values between two fingerprints are listed for two bits at most")
    width = _exact_length(max_bits, segments)
    masks = [_mask(i, width, segments) for i in range(segments)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("head", "mask"))
    keyed = keyed.select("fp", "head", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    sized = keyed.groupBy("head", "part").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1")
    keyed = materialize(keyed.join(sized, ["head", "part"]), "fingerprint-keys")

    few = keyed.where(F.col("n") <= paired)
    differing = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    within = F.coalesce(*[
        F.when(F.col("x.head") == i, _chain(i, max_bits, segments, differing)) for i in range(segments)
    ])
    pairs = few.alias("x").join(
        few.alias("y"),
        (F.col("x.head") == F.col("y.head")) & (F.col("x.part") == F.col("y.part"))
        & (F.col("x.fp") < F.col("y.fp")) & within & (F.bit_count(differing) <= max_bits),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    # Keys that many share: meet at the values one flipped bit away, bits of the key left out.
    free = F.array(*[
        F.array(*[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks
    ])
    many = keyed.where(F.col("n") > paired).withColumn("bits", F.element_at(free, F.col("head") + 1))
    if max_bits == 2:
        reached = many.select("head", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), "bits")).alias("bit"))
        reached = reached.select("fp", "head", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
        met = reached.groupBy("head", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
        stars = reached.join(met, ["head", "value"]).where("fp > a").select("a", F.col("fp").alias("b"))
    else:
        other = many.select("head", "fp", F.explode("bits").alias("bit")).select(
            "head", F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("bit")).alias("b")
        ).where("a < b")
        stars = other.join(many.select("head", F.col("fp").alias("b")), ["head", "b"]).select("a", "b")
        if not max_bits:
            stars = stars.where(F.lit(False))
    return pairs.union(stars).distinct()


def _components(rows: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """(fp, least, component) per distinct fingerprint: its first id and its component's smallest fingerprint."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(fingerprint_links(distinct.select("fp"), max_bits, segments))
    return distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """Per row its fingerprint and the smallest doc_id it is linked with, over any number of links."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    named = _components(rows, max_bits, segments)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(first, "component").select("fp", "component_id")
    return rows.join(label, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """docs without near copies: the row with the smallest doc_id of each component, and one of equal rows."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    last = F.lit((1 << 63) - 1)  # stands for no id
    heads = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", last)).alias("id"))
    named = _components(rows, max_bits, segments).select("fp", "component").join(heads, "fp")
    first = named.groupBy("component").agg(F.min("id").alias("id"))
    # The ids of several texts may be the same: the smallest fingerprint and text decide.
    heads = named.join(first, ["component", "id"]).groupBy("component", "id").agg(F.min("fp").alias("fp"))
    chosen = rows.select(F.coalesce("doc_id", last).alias("id"), "text_key", "fp").join(heads, ["id", "fp"])
    chosen = materialize(
        chosen.groupBy("id", "fp").agg(F.min("text_key").alias("key")).select("id", "key"), "near-copies-kept"
    )
    named_docs = docs.select(F.struct(F.col("*")).alias("_doc")).select(
        "_doc", F.coalesce(F.col("_doc.doc_id").cast("long"), last).alias("id"),
        F.xxhash64(F.coalesce("_doc.text", F.lit(""))).alias("key"),
    )
    # The ids that stay grow with the corpus: one plan at every size.
    return named_docs.join(chosen.hint("merge"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("_doc.*")
