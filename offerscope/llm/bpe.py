"""Encode whole texts to token ids and back, by tree concatenation.

Each task reads its rows in Arrow batches and encodes them with ``WordBpe``, which cuts
long unsplit text into halves, encodes all pieces side by side and joins them exactly (see
``wordbpe``).  No row is shuffled.  The vocabulary file is read once by the driver and sent
to each executor; its size does not depend on the data.

Defined results: a null or empty text has no tokens; the strings of special tokens in a
text become those tokens; repeated rows are encoded one by one; an empty table gives an
empty result; columns other than those kept are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.shingle_join import unused
from offerscope.llm.wordbpe import WordBpe, worker_encoder

#: Rows of a batch are encoded in groups of about so many characters.
GROUP_CHARS = 2_000_000


def text_groups(texts: pa.Array, limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """The texts in order (null: empty), a few at a time."""
    group, size = [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        group.append(text)
        size += len(text)
        if size > limit:
            yield group
            group, size = [], 0
    yield group


def map_encodings(
    docs: DataFrame,
    vocabulary: str,
    text: str,
    keep: Sequence[str],
    make: Callable[[list[bytes], WordBpe], pa.RecordBatch],
    schema: T.StructType,
) -> DataFrame:
    """``keep`` columns and the columns that ``make`` gives for the ids of a few texts at a time.

    The ids of a text are little-endian unsigned 32-bit integers.  ``make`` may return
    several rows for a text: a column ``_text`` then says which text of its list a row
    belongs to, and is dropped.
    """
    file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    n_keep = len(keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(file.value)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(n_keep)):
                made = make(list(encoder.encode_batch(group)), encoder)
                kept = batch.select(range(n_keep)).slice(at, len(group))
                at += len(group)
                columns = {name: made.column(name) for name in made.schema.names}
                if "_text" in columns:
                    kept = kept.take(columns.pop("_text"))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *columns.values()], names=[*kept.schema.names, *columns]
                )

    whole = unused(docs.select(*keep), "_whole_text")
    rows = docs.select(*keep, F.col(text).cast("string").alias(whole))
    out = T.StructType([*rows.select(*keep).schema.fields, *schema.fields])
    return rows.mapInArrow(encode, out)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded`` of every text."""

    def make(found: list[bytes], encoder: WordBpe) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in found]
        return pa.RecordBatch.from_pydict(
            {
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array([encoder.decode(x.tolist()) for x in ids], pa.string()),
            }
        )

    schema = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return map_encodings(docs, vocabulary, text, keep, make, schema)


def digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and checksums of the decimal ids and of the decoded text."""

    def make(found: list[bytes], encoder: WordBpe) -> pa.RecordBatch:
        decimal = [str(i) for i in range(len(encoder.tokens))]
        spelled = encoder.tokens
        ids_sha, decoded_sha = [], []
        for x in found:
            ids = np.frombuffer(x, "<u4").tolist()
            ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(" ".join([spelled[i] for i in ids]).encode()).hexdigest())
        return pa.RecordBatch.from_pydict(
            {
                "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                "ids_sha256": pa.array(ids_sha, pa.string()),
                "decoded_sha256": pa.array(decoded_sha, pa.string()),
            }
        )

    schema = (
        T.StructType().add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    )
    return map_encodings(docs, vocabulary, text, keep, make, schema)
