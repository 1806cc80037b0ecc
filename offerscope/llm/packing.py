"""Pack documents into token sequences of one length by bin completion.

1. Tasks encode the texts and cut only those longer than a sequence.  Pieces are narrow
   rows (no text, no ids) and are staged.
2. Pieces are numbered inside their length by a range partitioning (``number_slots``).
3. The histogram of lengths, at most ``capacity`` rows whatever the data's size, goes to
   the driver, which runs bin completion on it (``bins``).
4. The plan says for each length which numbers go to which sequences at which offset.  It
   has a few rows for each length, again whatever the data's size, and is sent to the tasks.

Defined results: a null or empty text is one piece that holds the closing token only;
repeated rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.bins import BUDGET, Pattern, bin_completion
from offerscope.llm.bpe import map_encodings
from offerscope.llm.sharding import number_slots
from offerscope.llm.wordbpe import WordBpe

PIECES = (
    T.StructType()
    .add("piece", T.IntegerType())
    .add("start", T.LongType())
    .add("length", T.LongType())
    .add("ids_crc32", T.LongType())
)


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str, keep: Sequence[str]
) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32: one row per piece of each text."""
    closing = end_id.to_bytes(4, "little")

    def make(found: list[bytes], _: WordBpe) -> pa.RecordBatch:
        rows = []
        for i, ids in enumerate(found):
            ids += closing
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["_text", "piece", "start", "length", "ids_crc32"],
        )

    return map_encodings(docs, vocabulary, text, keep, make, PIECES)


def plan_rows(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows of (first number, copies in a sequence, first sequence, offset), by number."""
    taken: dict[int, int] = {}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for sizes, bins in patterns:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            copies = sizes.count(size)
            first = taken.get(size, 0)
            plan.setdefault(size, []).append((first, copies, sequence, offset))
            taken[size] = first + copies * bins
            offset += copies * size
        sequence += bins
    return {size: np.array(rows, np.int64) for size, rows in plan.items()}


def assign(numbered: DataFrame, plan: dict[int, np.ndarray]) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``number`` inside their ``length``."""
    sent = numbered.sparkSession.sparkContext.broadcast(plan)
    names = [c for c in numbered.columns if c != "number"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            numbers = batch.column("number").to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = sent.value[int(length)]
                first, copies, sequence, offset = rows[np.searchsorted(rows[:, 0], numbers[at], "right") - 1].T
                within = numbers[at] - first
                sequences[at] = sequence + within // copies
                offsets[at] = offset + within % copies * length
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequences), pa.array(offsets)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = T.StructType(
        [*numbered.select(*names).schema.fields]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return numbered.mapInArrow(place, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    text: str = "text",
    key: str = "doc_id",
    budget: int = BUDGET,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, vocabulary, capacity, end_id, text, [key])
    numbered = number_slots(cut, "length", [key, "piece", "ids_crc32"], "number")
    histogram = numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    rows = histogram.limit(capacity + 1).collect()
    if len(rows) > capacity:
        raise ValueError("more lengths than a sequence allows")
    patterns = bin_completion({r["length"]: r["n"] for r in rows}, capacity, budget)
    return assign(numbered.select(key, *PIECES.names, "number"), plan_rows(patterns))
