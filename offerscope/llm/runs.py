"""Periodic runs of words, by tiles per octave of periods.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``max(least, power * q)`` words long, that no neighbouring word extends with period q.

1. Words become numbers (equal words, equal numbers).  For every octave of periods [P, 2P)
   the text is laid out in overlapping tiles, one around every boundary b, a multiple of 2P.
2. Inside a tile the block at the boundary is looked up at all lags q of the octave by hashes
   of blocks; where it occurs again, the Z-functions at the boundary, forwards and
   backwards, say how far words q apart stay equal.  They compare the words themselves, so
   hashes only pick lags.  A run of period q has ``power * q - q >= 3P`` equalities in a row, so
   the block of some boundary lies inside them.
3. Fragments of one period that touch are stitched.  A stretch found with several periods
   keeps the smallest.

A text of up to ``whole`` words stays in its task: all its tiles are solved there, for many texts
side by side, and no row is shuffled.  A longer text goes out as rows: tiles of at least
``whole`` words hold all short octaves, longer octaves have tiles of their own.  Tiles are
dealt to other tasks, solved independently, and the fragments are shuffled by text and
period and stitched there.  Both ways give the same runs.

Defined results: a null or empty text has no words and no runs; a null key is a key like any
other; repeated rows are judged one by one; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.session import stage

#: Words up to which a text is solved in the task that reads it.
WHOLE = 8192
#: Periods below this are compared directly, one by one.
DIRECT = 8
#: Words solved side by side in one call.
GROUP_WORDS = 1 << 18
#: Numbers compared at once by the Z-functions.
CELLS = 1 << 21

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    return x ^ (x >> U(29))


def _join(fragments: np.ndarray) -> np.ndarray:
    """Rows (q, start, stop) of equalities; those of one q that touch or overlap become one."""
    if not len(fragments):
        return fragments
    q, start, stop = fragments[np.lexsort((fragments[:, 2], fragments[:, 1], fragments[:, 0]))].T
    # inside a q stops may fall back; a large offset per q keeps the running maximum apart
    step = np.r_[True, q[1:] != q[:-1]].cumsum() * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + step) - step
    first = np.r_[True, (q[1:] != q[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    return np.stack([q[at], start[at], np.maximum.reduceat(stop, at)], 1)


def _smallest(fragments: np.ndarray) -> np.ndarray:
    """Of fragments that cover the same words with several periods, the smallest period."""
    if not len(fragments):
        return fragments
    fragments = fragments[np.lexsort((fragments[:, 0], fragments[:, 2] + fragments[:, 0], fragments[:, 1]))]
    start, end = fragments[:, 1], fragments[:, 2] + fragments[:, 0]
    return fragments[np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]]


def _direct(words: np.ndarray, q: int, edges: np.ndarray, need: int) -> np.ndarray:
    """Stretches of ``need`` equalities at lag q, and shorter ones that reach an edge."""
    if len(words) <= q:
        return np.empty((0, 3), np.int64)
    same = np.r_[False, words[:-q] == words[q:], False]
    turns = np.flatnonzero(same[1:] != same[:-1])
    start, stop = turns[::2], turns[1::2]
    keep = (stop - start >= need) | np.isin(start, edges) | np.isin(stop + q, edges)
    return np.stack([np.full(int(keep.sum()), q), start[keep], stop[keep]], 1)


def _z_at_boundaries(words: np.ndarray, b: np.ndarray, q: np.ndarray, octave: int) -> np.ndarray:
    """(q, start, stop): the equalities at lag q around each boundary b, at most 2P back and 3P on."""
    found = []
    span = np.arange(-2 * octave, 3 * octave)
    last = len(words) - 1
    for at in range(0, len(b), max(1, CELLS // len(span))):
        bb, qq = b[at : at + max(1, CELLS // len(span))], q[at : at + max(1, CELLS // len(span))]
        i = bb[:, None] + span
        j = i + qq[:, None]
        same = (words[np.clip(i, 0, last)] == words[np.minimum(j.clip(0), last)]) & (i >= 0) & (j <= last)
        ahead = np.c_[~same[:, 2 * octave :], np.ones(len(bb), bool)].argmax(1)
        back = np.c_[~same[:, 2 * octave - 1 :: -1], np.ones(len(bb), bool)].argmax(1)
        found.append(np.stack([qq, bb - back, bb + ahead], 1))
    return np.concatenate(found)


def solve(
    words: np.ndarray, longest: int, least: int = 6, power: int = 4, lengths: np.ndarray | None = None, open_: bool = False
) -> np.ndarray:
    """Fragments (q, start, stop) with words[i] == words[i + q] for start <= i < stop, q <= ``longest``.

    ``lengths``: sizes of the texts that lie side by side in ``words``, each with its own closing
    number; None for one text without one.  With ``open_`` the words are a tile of a longer text:
    stretches that reach an end of the tile come out however short they are.
    """
    n = len(words)
    edges = np.array([0, n] if open_ else [], np.int64)
    found = [_direct(words, q, edges, max(least, power * q) - q) for q in range(1, min(DIRECT - 1, longest, n - 1) + 1)]
    known = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    long_enough = lambda f: (f[:, 2] - f[:, 1] + f[:, 0] >= np.maximum(least, power * f[:, 0]))
    known = _smallest(known)
    octave = DIRECT
    hashes, where = mix(words.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)), np.arange(n)
    for _ in range(DIRECT.bit_length() - 1):  # hashes of DIRECT words
        hashes = _doubled(hashes, 1 << _)
    sizes = lengths
    while octave <= longest:
        if sizes is not None:  # texts too short for the octave leave
            stay = sizes >= power * octave
            if not stay.any():
                break
            if not stay.all():
                mask = np.repeat(stay, sizes + 1)
                hashes, where, sizes = hashes[mask], where[mask], sizes[stay]
        elif n < (2 if open_ else power) * octave:
            break
        step = 2 * octave
        tiles = -(-len(hashes) // step)
        padded = np.zeros((tiles + 1) * step, U)
        padded[: len(hashes)] = hashes
        at_boundary = padded[: tiles * step : step]
        lags = np.lib.stride_tricks.as_strided(padded[octave:], (tiles, octave), (8 * step, 8))
        x, lag = np.nonzero(lags == at_boundary[:, None])
        real = (x * step < len(hashes)) & (x * step + octave + lag < len(hashes))
        b, q = where[x[real] * step], lag[real] + octave
        q_ok = q <= longest
        b, q = b[q_ok], q[q_ok]
        if len(b):
            # inside a run of a smaller period, a lag can only be a multiple of it
            runs = known[long_enough(known) & (known[:, 0] < octave)]
            if len(runs):
                order = np.argsort(runs[:, 1], kind="stable")
                starts, reach = runs[order, 1], np.maximum.accumulate((runs[:, 2] + runs[:, 0])[order])
                place = np.searchsorted(starts, b, "right") - 1
                free = (place < 0) | (reach[np.maximum(place, 0)] < b + octave + q)
                b, q = b[free], q[free]
        if len(b):
            fragments = _join(_z_at_boundaries(words, b, q, octave))
            keep = long_enough(fragments)
            if open_:
                keep |= (fragments[:, 1] == 0) | (fragments[:, 2] + fragments[:, 0] == n)
            known = _smallest(np.concatenate([known, fragments[keep]]))
        hashes = _doubled(hashes, octave)
        octave *= 2
    return known


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 * ``size`` words from those of ``size``; past the end the words count as zeros."""
    after = np.zeros_like(hashes)
    after[: max(0, len(hashes) - size)] = hashes[size:]
    return mix(hashes * U(0xD6E8FEB86659FD93) + (after ^ (after >> U(32))) * U(0xA0761D6478BD642F))


def runs_of(fragments: np.ndarray, least: int, power: int) -> np.ndarray:
    """Stitched runs (start, length, period) by start, then period."""
    joined = _join(fragments)
    if len(joined):
        joined = _smallest(joined[joined[:, 2] - joined[:, 1] + joined[:, 0] >= np.maximum(least, power * joined[:, 0])])
    runs = np.stack([joined[:, 1], joined[:, 2] - joined[:, 1] + joined[:, 0], joined[:, 0]], 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the greatest run's start, length, period, exponent in thousandths, and two checksums."""
    listing = "".join([f"{s},{length},{q}\n" for s, length, q in runs.tolist()])
    if len(runs):
        s, length, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = (s, length, q, 1000 * length // q)
        drops = np.zeros(len(words) + 1, np.int64)
        np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drops, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(drops.cumsum()[:-1] == 0).tolist()]
    else:
        best = (None,) * 4
    return (
        len(runs),
        *best,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(b" ".join(words)).hexdigest(),
    )


DIGEST = (
    T.StructType()
    .add("n_runs", T.LongType())
    .add("start", T.LongType())
    .add("length", T.LongType())
    .add("period", T.LongType())
    .add("exponent_milli", T.LongType())
    .add("runs_sha256", T.StringType())
    .add("collapsed_sha256", T.StringType())
)
KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)]


#: Which original word stands at each place: from the key's decimal text and the number of words;
#: None for all as they are.
Rewrite = Callable[[bytes, int], "np.ndarray | None"]


def _first_pass(whole: int, least: int, power: int, rewrite: Rewrite | None):
    """key, decimal key, text -> key, digest columns (of texts up to ``whole`` words), and the
    words of longer ones joined by a space."""

    def side_by_side(texts: list[list[bytes]]) -> list[np.ndarray]:
        numbers: dict[bytes, int] = {}
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.full(int(lengths.sum()) + len(texts), -1, np.int64)
        closing = np.cumsum(lengths + 1) - 1
        at = 0
        for t in texts:
            flat[at : at + len(t)] = list(map(numbers.setdefault, t, count(len(numbers) + at)))
            at += len(t) + 1
        flat[closing] = -1 - np.arange(len(texts))
        found = solve(flat, int(lengths.max(initial=0)) // power, least, power, lengths)
        runs = runs_of(found, least, power)
        bounds = np.searchsorted(runs[:, 0], np.r_[0, closing + 1])
        starts = np.r_[0, closing + 1]
        return [runs[a:b] - [s, 0, 0] for a, b, s in zip(bounds, bounds[1:], starts)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple | None] = [None] * batch.num_rows
            long_texts: list[bytes | None] = [None] * batch.num_rows
            group: list[tuple[int, list[bytes]]] = []
            size = 0

            def flush() -> None:
                for (i, words), runs in zip(group, side_by_side([w for _, w in group])):
                    rows[i] = digest(words, runs)
                group.clear()

            for i in range(batch.num_rows):
                words = (batch.column(2)[i].as_py() or b"").split()
                places = rewrite(batch.column(1)[i].as_py(), len(words)) if rewrite else None
                if places is not None:
                    words = [words[k] for k in places.tolist()]
                if len(words) > whole:
                    rows[i], long_texts[i] = (None,) * len(KINDS), b" ".join(words)
                    continue
                group.append((i, words))
                size += len(words)
                if size > GROUP_WORDS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_columns(rows), pa.array(long_texts, pa.binary())],
                names=[batch.schema.names[0], *DIGEST.names, "long_text"],
            )

    return first


def tile_bounds(n: int, whole: int) -> list[tuple[int, int, int, int]]:
    """(smallest period, longest period, first word, end) of the tiles of a text of n words.

    Neighbouring tiles of one octave [P, 2P) overlap by 5P words, so that whatever part of 3P
    equalities lies across an edge is found from one of its sides.
    """
    octave = DIRECT
    while 16 * octave <= whole:
        octave *= 2
    found = [(1, octave - 1, at, min(n, at + whole + 5 * octave // 2)) for at in range(0, n, whole)]
    while 2 * octave < n:
        found += [(octave, 2 * octave - 1, at, min(n, at + 9 * octave)) for at in range(0, n, 4 * octave)]
        octave *= 2
    return found


TILES = "uid long, low int, high int, first long, words binary"


def _tiles(whole: int):
    """uid, text -> its tiles, each with the numbers of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter(map(numbers.setdefault, words, count()), np.int32, len(words))
                del words, numbers
                for low, high, a, b in tile_bounds(len(ids), whole):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid], pa.int64()),
                            pa.array([low], pa.int32()),
                            pa.array([high], pa.int32()),
                            pa.array([a], pa.int64()),
                            pa.array([ids[a:b].tobytes()], pa.binary()),
                        ],
                        names=["uid", "low", "high", "first", "words"],
                    )

    return cut


def _solve_tiles(least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, low, high, first, words in zip(*[c.to_pylist() for c in batch.columns]):
                found = solve(np.frombuffer(words, np.int32), high, least, power, open_=True)
                found = found[found[:, 0] >= low]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), uid), pa.int64()),
                        pa.array(found[:, 0], pa.int64()),
                        pa.array(found[:, 1] + first, pa.int64()),
                        pa.array(found[:, 2] + first, pa.int64()),
                    ],
                    names=["uid", "q", "start", "stop"],
                )

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by uid, q, start -> stitched ones.  One is held over to the next batch."""
    held = np.empty((0, 4), np.int64)

    def merged(rows: np.ndarray) -> np.ndarray:
        uid, q, start, stop = rows.T
        changed = np.r_[True, (uid[1:] != uid[:-1]) | (q[1:] != q[:-1])]
        step = changed.cumsum() * (int(stop.max()) + 2)
        reach = np.maximum.accumulate(stop + step) - step
        at = np.flatnonzero(changed | np.r_[True, start[1:] > reach[:-1]])
        return np.stack([uid[at], q[at], start[at], np.maximum.reduceat(stop, at)], 1)

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows.T], names=["uid", "q", "start", "stop"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
        if len(rows):
            rows = merged(rows)
            yield out(rows[:-1])
            held = rows[-1:]
    yield out(held)


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, runs (list of start, length, period) -> key and digest columns."""
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1), batch.column(2)):
            listed = [(r["start"], r["length"], r["q"]) for r in runs.as_py() or ()]
            rows.append(digest(text.as_py().split(), np.array(sorted(listed, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], names=[batch.schema.names[0], *DIGEST.names])


def long_runs(texts: DataFrame, whole: int = WHOLE, least: int = 6, power: int = 4) -> DataFrame:
    """uid, start, length, q of all runs of ``texts`` (uid, long_text), from tiles in other tasks."""
    tiles = texts.select("uid", "long_text").mapInArrow(_tiles(whole), TILES).repartition("uid", "low", "first")
    fragments = tiles.mapInArrow(_solve_tiles(least, power), "uid long, q long, start long, stop long")
    stitched = (
        fragments.repartition("uid", "q")
        .sortWithinPartitions("uid", "q", "start")
        .mapInArrow(_stitch, "uid long, q long, start long, stop long")
    )
    return (
        stitched.withColumn("length", F.col("stop") - F.col("start") + F.col("q"))
        .filter(F.col("length") >= F.greatest(F.lit(least), power * F.col("q")))
        .groupBy("uid", "start", "length")
        .agg(F.min("q").alias("q"))
    )


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 6,
    power: int = 4,
    rewrite: Rewrite | None = None,
    whole: int = WHOLE,
) -> DataFrame:
    """key and the ``DIGEST`` columns of every row."""
    if power < 4 or whole < 16 * DIRECT:
        raise ValueError("runs need at least four periods, and whole texts 128 words")
    rows = docs.select(
        F.col(key).alias(key),
        F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary").alias("_decimal"),
        F.col(text).cast("binary").alias("_text"),
    )
    schema = T.StructType([rows.schema.fields[0], *DIGEST.fields, T.StructField("long_text", T.BinaryType())])
    passed = stage(rows.mapInArrow(_first_pass(whole, least, power, rewrite), schema), "runs")
    short = passed.filter("long_text IS NULL").drop("long_text")
    long_texts = stage(
        passed.filter("long_text IS NOT NULL").select(key, "long_text", F.monotonically_increasing_id().alias("uid")),
        "long-texts",
    )
    listed = (
        long_runs(long_texts, whole, least, power)
        .groupBy("uid")
        .agg(F.collect_list(F.struct("start", "length", "q")).alias("runs"))
    )
    judged = long_texts.join(listed, "uid", "left").select(key, "long_text", "runs")
    out = T.StructType([rows.schema.fields[0], *DIGEST.fields])
    return short.unionByName(judged.mapInArrow(_last_pass, out))
