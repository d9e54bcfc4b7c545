"""Best-fit packing of token sequences by sums of squares.

A sequence holds at most ``capacity`` tokens. Among the open sequences and a new
one, each piece goes where the sum of N(g)^2 is smallest afterwards, N(g) being the
number of open sequences with g tokens left; of equal choices, the one with the
least room left.

Only (document, piece, length) rows are shuffled, never ids. They are dealt evenly to
groups of about GROUP pieces, whatever their keys, and each group is packed by
itself, so that memory is bounded and the sequences that stay open are a fixed
small share.

Cases: a null text is an empty one and gives the end id alone. Rows with the same
doc_id, or none, are documents of their own. An empty table gives no rows. Other
columns are ignored. Texts of any length are cut into pieces of ``capacity`` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.texts import TextEncoder, blocks, id_and_text, tokenizer_path, worker_kept
from logtide.plans.common import materialize

GROUP = 65_536  # pieces packed together
SMALL = 8  # pieces of at most 1/SMALL of a sequence come last
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = f"{PIECES}, sequence_id long, offset long"


def token_pieces(
    docs: DataFrame, path: str, keeps_space: bool, end_id: int, capacity: int
) -> DataFrame:
    """A row per piece: its document's ids and the end id, cut every ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_kept(("encoder", path, keeps_space), lambda: TextEncoder(path, keeps_space))
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in blocks(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each length in turn the sequence that takes it, and the place in there."""
    import numpy as np

    closed = np.int64(1) << 40  # keeps gaps without a sequence out of the choice
    count = np.zeros(capacity + 1, np.int64)  # open sequences by tokens left; full ones are not counted
    offer = np.full(capacity + 1, -closed)  # the same, where there is one
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    chosen, places, made = [], [], 0
    for length in lengths:
        best, gap = 2 * int(count[capacity - length]) + (length < capacity), capacity
        if length < capacity:
            # From gap g the sum changes by 2 (N(g - length) - N(g)) + 2, and by 1 less if that fills it.
            change = count[: capacity - length] - offer[length:capacity]
            change += change
            change += 2
            change[0] -= 1
            at = int(change.argmin())
            if change[at] <= best and change[at] < closed // 2:
                gap = at + length
        if gap == capacity:
            sequence, made = made, made + 1
        else:
            sequence = open_[gap].pop()
            count[gap] -= 1
            offer[gap] = count[gap] or -closed
        left = gap - length
        if left:
            open_[left].append(sequence)
            count[left] += 1
            offer[left] = count[left]
        chosen.append(sequence)
        places.append(capacity - gap)
    return chosen, places


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to written pieces; ``length`` is at most ``capacity``."""
    groups = max(1, -(-pieces.count() // group))
    # Large pieces in falling size, then the small ones in no order of size, which fill what is left.
    dealt = pieces.withColumns({
        "_group": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"),
        "_size": F.greatest("length", F.lit(capacity // SMALL)), "_turn": F.xxhash64("doc_id", "piece"),
    })

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_size", "descending"), ("_turn", "ascending"), ("ids_crc32", "ascending")])
        chosen, places = sum_of_squares(rows["length"].to_pylist(), capacity)
        base = key[0].as_py() << 32
        return rows.drop_columns(["_group", "_size", "_turn"]).append_column(
            "sequence_id", pa.array([base + s for s in chosen], pa.int64())
        ).append_column("offset", pa.array(places, pa.int64()))

    return dealt.groupBy("_group").applyInArrow(place, PLACES)


def packed_sequences(
    docs: DataFrame,
    path: str | None = None,
    keeps_space: bool = False,
    end_id: int = 0,
    capacity: int = 2048,
) -> DataFrame:
    """Each piece of each document with the sequence that holds it and its place there."""
    path = path or tokenizer_path("word_bpe_49k.json")
    return pack(materialize(token_pieces(docs, path, keeps_space, end_id, capacity), "pieces"), capacity)
