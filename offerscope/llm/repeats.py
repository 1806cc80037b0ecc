"""Removal of repeated strings, by prefix-free parsing.

Every byte covered by a string of ``length`` bytes that also starts earlier in the corpus goes.
The corpus is ordered by key, then by place in the text; matches never cross texts.

1. Triggers.  A rolling hash of ``WINDOW`` bytes is taken at every place.  Of the places inside a
   string of ``length`` bytes the one with the least hash is the string's trigger, so that equal
   strings have equal triggers, at the same distance, whatever surrounds them.
2. Parse.  Neighbouring strings with one trigger place make a phrase: the text from the first to
   the end of the last.  Phrases overlap, like those of the textbook form, and each carries the
   bytes after it that its suffixes need.
3. Dictionary.  A string that occurs twice has its trigger twice, so phrases whose trigger hash
   occurs once in the corpus leave first.  Of the rest the different phrases are the dictionary,
   each with its first place.  A phrase at a later place than its first is a repeat as a whole.
4. Corpus order.  Where a trigger has several phrases, a suffix array of these dictionary phrases
   (``suffix_array``) puts their suffixes in order; equal ones, which are those with a common
   prefix of ``length`` bytes, keep the order of the parse, so that all but the first of an
   interval are repeats.  Equal strings have one trigger, so each trigger's phrases are sorted on
   their own.  A trigger with more than ``MANY`` phrases is not sorted by one task: its suffixes are
   dealt out by a digest of those bytes, and the least place of each is its first.

Only phrases with a repeated trigger are taken up, and only different ones are taken apart into
suffixes, so highly repetitive text costs little.  Counts and first places are added up before
they are shuffled; joins on hot triggers or phrases are ones that adaptive execution can split.
A text is cut every ``CHUNK`` places, so memory is bounded; cuts only add phrases.

Phrases are told apart by 64 bits of the trigger and 64 of a digest, suffixes by their bytes
(those of triggers with very many phrases by 128 bits of a digest).

Defined results: a null or empty text has no bytes and its hash is that of nothing; a null key
comes before all others; rows of one key count as one document with the same places, so that
repeated rows stay alike, and of two texts of a key what starts later goes; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.shingle_join import sorted_groups
from offerscope.session import free_shuffles, stage, unstage

LENGTH = 100
#: Bytes of the rolling hash.
WINDOW = 20
#: Bytes judged at once.
CHUNK = 1 << 17
#: Phrases whose suffixes are sorted at once, and from how many on those of one trigger are dealt out.
GROUP = 4096
MANY = 10_000
#: Low bits of a hash that give way to its place when the least is looked for.
PLACE = (1 << 20) - 1

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def widen(hashes: np.ndarray, size: int, width: int) -> np.ndarray:
    """Hashes of ``width`` bytes at each place, from those of ``size``, by doubling."""
    while size < width:
        gap = min(size, width - size)
        hashes = mix(hashes[:-gap] * U(0xC2B2AE3D27D4EB4F) + hashes[gap:])
        size += gap
    return hashes


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        gap = min(size, width - size)
        x = np.minimum(x[:-gap], x[gap:])
        size += gap
    return x


def parse(data: np.ndarray, sizes: np.ndarray, length: int, window: int, digests: bool) -> tuple[np.ndarray, ...]:
    """Phrases of pieces of text that lie side by side: trigger hash, piece, place of the first
    string in its piece, number of strings, digest (zeros unless asked for)."""
    if len(data) < length:
        return np.empty(0, np.int64), *[np.empty(0, np.int64)] * 4
    hashes = widen(mix(data.astype(U) + U(0x51)), 1, window)
    keys = (hashes & ~U(PLACE)) | np.arange(len(hashes), dtype=U)
    trigger = (sliding_min(keys, length - window + 1) & U(PLACE)).astype(np.int64)
    piece = np.repeat(np.arange(len(sizes)), sizes)[: len(trigger)]
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(len(trigger)) + length <= (begins + sizes)[piece]
    edge = np.flatnonzero(
        np.r_[True, (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1])]
    )
    n = np.diff(np.r_[edge, len(trigger)])
    at, n = edge[inside[edge]], n[inside[edge]]
    digest = np.zeros(len(at), U)
    if digests:
        # neighbouring strings overlap, so the first and the last cover a phrase
        whole = widen(hashes, window, length)
        digest = mix(whole[at] * U(0xE7037ED1A0B428DB) + whole[at + n - 1])
    return hashes[trigger[at]].view(np.int64), piece[at], at - begins[piece[at]], n, digest.view(np.int64)


def cut(texts: pa.Array, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of pieces of about ``CHUNK`` bytes: row, place in the row's text, bytes.

    Pieces of one text overlap so that every string of ``length`` bytes is in one of them.
    """
    rows, places, pieces, size = [], [], [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or b""
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            rows.append(i)
            places.append(at)
            pieces.append(text[at : at + CHUNK + length - 1])
            size += len(pieces[-1])
            if size > CHUNK:
                yield rows, places, pieces
                rows, places, pieces, size = [], [], [], 0
    if rows:
        yield rows, places, pieces


def _triggers(length: int, window: int):
    """text -> trigger hashes with the number of their phrases, added up inside a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                parse(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), length, window, False)[0]
                for _, _, pieces in cut(batch.column(0), length)
            ]
            t, n = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.int64())], names=["t", "n"])

    return count


PHRASES = "t long, d long, strings int, o long, r long, place long"


def _phrases(length: int, window: int):
    """o, r, text -> its phrases."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for rows, places, pieces in cut(batch.column(2), length):
                sizes = np.array([len(p) for p in pieces])
                t, piece, at, n, d = parse(np.frombuffer(b"".join(pieces), np.uint8), sizes, length, window, True)
                row = np.array(rows)[piece]
                columns = [t, d, n.astype(np.int32), o[row], r[row], at + np.array(places)[piece]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["t", "d", "strings", "o", "r", "place"]
                )

    return find


PIECES = "t long, many boolean, o long, r long, place long, strings int, phrase binary"


def _cut_phrases(length: int):
    """o, r, text, wanted phrases -> those phrases with their bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                o, r, text, wanted = (batch.column(c)[i].as_py() for c in range(4))
                for at in range(0, len(wanted), CHUNK // length):
                    part = wanted[at : at + CHUNK // length]
                    phrases = [text[p["place"] : p["place"] + p["strings"] + length - 1] for p in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["t"] for p in part], pa.int64()),
                            pa.array([p["many"] for p in part], pa.bool_()),
                            pa.array([o] * len(part), pa.int64()),
                            pa.array([r] * len(part), pa.int64()),
                            pa.array([p["place"] for p in part], pa.int64()),
                            pa.array([p["strings"] for p in part], pa.int32()),
                            pa.array(phrases, pa.binary()),
                        ],
                        names=["t", "many", "o", "r", "place", "strings", "phrase"],
                    )

    return make


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, equal ones in the order
    given; and where in it a new string begins."""
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts])
    strings = windows.view(f"V{length}").ravel()
    order = np.argsort(strings, kind="stable")
    ordered = strings[order]
    return order, np.r_[True, ordered[1:] != ordered[:-1]]


def _later_suffixes(length: int):
    """Phrases sorted by trigger, then corpus order -> o, r, start, stop of suffixes that came earlier.

    Phrases of one trigger are taken together, as many triggers at a time as make ``GROUP`` phrases.
    """

    def spans(table: pa.Table) -> pa.RecordBatch:
        get = lambda name: table.column(name).to_numpy()
        strings = get("strings").astype(np.int64)
        data = np.frombuffer(b"".join(table.column("phrase").to_pylist()), np.uint8)
        phrase = np.repeat(np.arange(len(strings)), strings)
        inside = np.arange(len(phrase)) - np.repeat(np.cumsum(strings) - strings, strings)
        begins = np.cumsum(strings + length - 1) - (strings + length - 1)
        order, new = suffix_array(data, begins[phrase] + inside, length)
        o, place = get("o")[phrase], get("place")[phrase] + inside
        first = order[np.flatnonzero(new)][new.cumsum() - 1]
        later = np.sort(order[(o[order] != o[first]) | (place[order] != place[first])])
        start = place[later]
        # neighbours in one phrase are one span
        edge = np.r_[True, (phrase[later][1:] != phrase[later][:-1]) | (start[1:] != start[:-1] + 1)][: len(later)]
        at = np.flatnonzero(edge)
        stop = start[np.r_[at[1:], len(later)][: len(at)] - 1] + length
        rows = phrase[later][at]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (get("o")[rows], get("r")[rows], start[at], stop)],
            names=["o", "r", "start", "stop"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for group in sorted_groups(batches, 1):
            held.append(group)
            if sum(g.num_rows for g in held) >= GROUP:
                yield spans(pa.concat_tables(held))
                held = []
        if held:
            yield spans(pa.concat_tables(held))

    return find


SUFFIXES = "w1 long, w2 long, o long, r long, place long"


def _suffixes(length: int):
    """Phrases -> digests of the first ``length`` bytes of their suffixes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                o, r, place, strings, phrase = (batch.column(c)[i].as_py() for c in range(2, 7))
                words = b"".join([hashlib.blake2b(phrase[k : k + length], digest_size=16).digest() for k in range(strings)])
                words = np.frombuffer(words, np.int64).reshape(-1, 2)
                columns = [words[:, 0], words[:, 1], np.full(strings, o), np.full(strings, r), place + np.arange(strings)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns],
                    names=["w1", "w2", "o", "r", "place"],
                )

    return make


def kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, removed runs, and what is left after ``spans`` (start, stop) have gone."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    edges = [0, *[x for span in merged for x in span], len(text)]
    left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
    return len(text) - len(left), len(merged), left


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, spans -> key, n_bytes, n_removed, n_spans, kept text."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or b""
            spans = [(s["start"], s["stop"]) for s in batch.column(2)[i].as_py() or ()]
            removed, runs, left = kept(text, spans) if spans else (0, 0, text)
            rows.append((len(text), removed, runs, left))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()])]],
            names=[batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _repeated_phrases(rows: DataFrame, length: int, window: int) -> DataFrame:
    """All phrases whose trigger occurs more than once."""
    repeated = stage(
        rows.select("text")
        .mapInArrow(_triggers(length, window), "t long, n long")
        .groupBy("t")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
        .select("t"),
        "triggers",
    )
    free_shuffles(rows.sparkSession)
    hits = stage(
        rows.select("o", "r", "text").mapInArrow(_phrases(length, window), PHRASES).join(repeated, "t"), "phrases"
    )
    unstage(repeated)
    return hits


def _pieces(rows: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """The dictionary's phrases of triggers that have several, with their bytes."""
    several = dictionary.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = (
        dictionary.join(several.select("t", (F.col("n") > MANY).alias("many")), "t")
        .groupBy("first.o", "first.r")
        .agg(F.collect_list(F.struct("t", "many", "first.place", "strings")).alias("wanted"))
    )
    found = rows.join(wanted, ["o", "r"]).select("o", "r", "text", "wanted").mapInArrow(_cut_phrases(length), PIECES)
    return stage(found, "dictionary-phrases")


def _dictionary(hits: DataFrame) -> DataFrame:
    """The different phrases, their number, and where each is first."""
    found = hits.groupBy("t", "d", "strings").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "place", "r")).alias("first")
    )
    return stage(found, "dictionary")


def _later_phrases(hits: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """Whole phrases at later places than their first."""
    again = dictionary.filter("n > 1").select("t", "d", "strings", "first")
    found = (
        hits.join(again, ["t", "d", "strings"])
        .filter(F.struct("o", "place") > F.struct("first.o", "first.place"))
        .select("o", "r", F.col("place").alias("start"), (F.col("place") + F.col("strings") + length - 1).alias("stop"))
    )
    return stage(found, "spans")


def _later_parts(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes, of dictionary phrases that share a trigger, that came earlier."""
    few = (
        pieces.filter("NOT many")
        .repartition("t")
        .sortWithinPartitions("t", "o", "place")
        .mapInArrow(_later_suffixes(length), "o long, r long, start long, stop long")
    )
    # a trigger with very many phrases: their suffixes are dealt out by digest
    place = F.struct("o", "place")
    suffixes = stage(pieces.filter("many").mapInArrow(_suffixes(length), SUFFIXES), "suffixes")
    intervals = suffixes.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    parts = (
        suffixes.join(intervals.filter("first < last").drop("last"), ["w1", "w2"])
        .filter(place > F.col("first"))
        .select("o", "r", F.col("place").alias("start"), (F.col("place") + length).alias("stop"))
    )
    found = stage(few, "spans"), stage(parts, "spans")
    unstage(suffixes)
    return found


def repeated_spans(rows: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """o, r, start, stop of repeated strings in ``rows`` (o: place in the corpus order, r: a hash of
    the row, text: binary); touching and overlapping ones are left as they are.

    Each step's table is written and the one before it, with the shuffle files, goes, so that the
    disk holds one or two of them at a time.
    """
    spark = rows.sparkSession
    hits = _repeated_phrases(rows, length, window)
    free_shuffles(spark)
    dictionary = _dictionary(hits)
    free_shuffles(spark)
    whole = _later_phrases(hits, dictionary, length)
    unstage(hits)
    free_shuffles(spark)
    pieces = _pieces(rows, dictionary, length)
    unstage(dictionary)
    free_shuffles(spark)
    few, parts = _later_parts(pieces, length)
    unstage(pieces)
    free_shuffles(spark)
    return whole.unionByName(few).unionByName(parts)


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (binary) of every row.  The key is an integer."""
    if not 0 < window < length <= window + CHUNK:
        raise ValueError("the rolling hash is shorter than the strings")
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(
        F.col(key).alias("_key"),
        order.alias("o"),
        F.xxhash64(order, F.col(text).cast("binary")).alias("r"),
        F.col(text).cast("binary").alias("text"),
    )
    spans = (
        repeated_spans(rows.drop("_key"), length, window)
        .groupBy("o", "r")
        .agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    found = rows.join(spans, ["o", "r"], "left").select(F.col("_key").alias(key), "text", "spans")
    out = T.StructType([found.schema.fields[0]])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        out = out.add(name, kind)
    return found.mapInArrow(_remove, out)
