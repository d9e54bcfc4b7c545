"""Secret scans with parts of one credential linked.

Each kind is found leftmost and without overlaps. Strong parts (assign, access, hex)
are always reported. Weak parts, which alone mean little, are reported only if
parts that complete them lie within SCOPE code points in the same text, measured from the
end of the earlier to the start of the later:

* weak_id (short access keys, names of users and clients): needs a secret,
* weak_secret (short assigned values): needs an identifier or an endpoint,
* endpoint (URLs, addresses, hosts with a port): needs an identifier and a secret.

The co-occurrence is an interval join of weak parts with per-slot extremes: texts are
cut in slots of SCOPE code points, a part is in every slot it reaches, and of each slot
and role only the first start and the last end take part, which decides every case with at
most one row per slot and role. So a text full of parts makes no pairs.

Cases: a null text is an empty one; a text without parts gives zero counts and empty
spans. Rows that repeat a doc_id, or have none, are texts of their own. An empty table
gives no rows. Other columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.texts import blocks, id_and_text
from logtide.plans.common import materialize

SCOPE = 400
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
N_STRONG = 3
ROLES = ("secret", "id", "secret", "id", "secret", "endpoint")  # of the kinds, in their order

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same spans as runs of any length that are then held to 16
NAMED_ID = (
    r"""(?:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""
)
SHORT_SECRET = r"""(?:pwd|pass|private_?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
ENDPOINT = (
    r"https?://[^\s\"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b"
    r"|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b"
)


def _finder():
    import re

    flags = re.ASCII | re.IGNORECASE
    assign, access, hexes = re.compile(ASSIGN, flags), re.compile(ACCESS), re.compile(HEX)
    named, short = re.compile(NAMED_ID, flags), re.compile(SHORT_SECRET, flags)
    endpoint, mark = re.compile(ENDPOINT, re.ASCII), re.compile(r"[:=]")

    def find(text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of all parts, weak ones included."""
        found = [(2, *m.span()) for m in hexes.finditer(text)]
        if "AKIA" in text:
            for m in access.finditer(text):
                length = m.end() - m.start()
                if length >= 18 or length >= 8:
                    found.append((1 if length >= 18 else 3, *m.span()))
        if mark.search(text):
            for m in assign.finditer(text):
                length = m.end(2) - m.start(2)
                if length >= 12 or length >= 6:
                    found.append((0 if length >= 12 else 4, *m.span()))
            found += [(3, *m.span()) for m in named.finditer(text)]
            found += [(4, *m.span()) for m in short.finditer(text)]
        if "." in text or ":" in text:
            found += [(5, *m.span()) for m in endpoint.finditer(text)]
        return found

    return find


def credential_parts(docs: DataFrame) -> DataFrame:
    """A row per text with its parts; no text goes any further."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder()
        parts_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in blocks(batches):
            parts = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in batch["text"]
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(parts, parts_type)], ["doc_id", "parts"])

    return id_and_text(docs).mapInArrow(
        found, "doc_id long, parts array<struct<kind: int, start: bigint, end: bigint>>"
    )


def completed_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts (row, kind, start, end) that complementary parts complete."""
    roles = F.array(*[F.lit(r) for r in ROLES])
    each = parts.where(F.exists("parts", lambda p: p["kind"] >= N_STRONG)).select(
        "row", F.explode("parts").alias("p")
    ).select("row", "p.*").withColumn("role", F.element_at(roles, F.col("kind") + 1))
    each = each.withColumns({"low": F.floor(F.col("start") / scope), "high": F.floor(F.col("end") / scope)})
    extremes = each.withColumn("slot", F.explode(F.sequence("low", "high"))).groupBy("row", "slot", "role").agg(
        F.min("start").alias("first"), F.max("end").alias("last")
    ).withColumnRenamed("role", "other")
    weak = each.where(F.col("kind") >= N_STRONG).select(
        "row", "kind", "start", "end", "role",
        F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("slot"),
    )
    # In a slot that a part reaches every other part is near; in the one before, the last end
    # decides, in the one behind the first start.
    near = (F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope)
    met = weak.join(extremes, ["row", "slot"]).where(near & (F.col("role") != F.col("other")))
    seen = lambda role: F.max((F.col("other") == role).cast("int"))
    linked = met.groupBy("row", "kind", "start", "end", "role").agg(
        seen("secret").alias("secret"), seen("id").alias("id"), seen("endpoint").alias("endpoint")
    )
    complete = (
        F.when(F.col("role") == "id", F.col("secret") == 1)
        .when(F.col("role") == "secret", F.col("id") + F.col("endpoint") >= 1)
        .otherwise(F.col("id") + F.col("secret") == 2)
    )
    return linked.where(complete).select("row", "kind", "start", "end")


def _spans(parts):
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"], p["kind"], p["end"])))
    return F.array_join(
        F.transform(ordered, lambda p: F.concat_ws(
            ":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))),
        ",",
    )


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: counts and digest of the strong spans, and all reported spans."""
    rows = materialize(credential_parts(docs), "credential-parts")
    # The written table is read in the same order every time, which makes the number of a row stable.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-parts")
    linked = completed_parts(rows, scope).groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("linked")
    )
    strong = F.filter("parts", lambda p: p["kind"] < N_STRONG)
    empty = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")
    return rows.join(linked, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_spans(strong), 256).alias("base_sha256"),
        _spans(F.concat(strong, F.coalesce("linked", empty))).alias("spans"),
    )
