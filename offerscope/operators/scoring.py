"""Scores of every offer for every row, as one array column.

The products of rows and weights, and the draws, run in numpy over Arrow batches.
What follows from the probabilities (value, ranking, choice) stays in built-in
expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from offerscope.operators.posterior import LOGIT_BOUND, Arm

SEED = 42


def _matrix(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _as_lists(logits: np.ndarray) -> pa.Array:
    p = 1.0 / (1.0 + np.exp(-np.clip(logits, -LOGIT_BOUND, LOGIT_BOUND)))
    n, width = p.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(p.ravel()))


def key_words(key: Column) -> list[Column]:
    """Two 32-bit words of a digest of the key, as whole numbers."""
    return [F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("bigint") for at in (1, 9)]


def salts(names: Sequence[str]) -> np.ndarray:
    """Two 32-bit words for each name."""
    digests = [hashlib.md5(name.encode()).hexdigest() for name in names]
    return np.array([[int(d[at : at + 8], 16) for d in digests] for at in (0, 8)], np.uint64)


def mixed(words: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit numbers (the finaliser of a public 32-bit hash)."""
    low = np.uint64(0xFFFFFFFF)
    words = words ^ (words >> np.uint64(16))
    words = (words * np.uint64(0x85EBCA6B)) & low
    words = words ^ (words >> np.uint64(13))
    words = (words * np.uint64(0xC2B2AE35)) & low
    return words ^ (words >> np.uint64(16))


def keyed_normals(first: np.ndarray, second: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One standard normal per key and name: Box-Muller on the key's words mixed with the name's."""
    u, v = ((mixed(w.astype(np.uint64)[:, None] ^ s).astype(float) + 0.5) / 4294967296.0 for w, s in zip((first, second), salt))
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


def _entries(p: Column, arms: Sequence[Arm]) -> Column:
    """(score, tie, offer_id, p) per arm; the largest entry is the choice, smallest id first."""
    ids = F.lit([a.offer_id for a in arms])
    values = F.lit([a.value for a in arms])
    return F.transform(
        p,
        lambda one, i: F.struct(
            (one * F.get(values, i)).alias("score"), (-i).alias("tie"), F.get(ids, i).alias("offer_id"), one.alias("p")
        ),
    )


def map_scores(arms: Sequence[Arm]) -> Column:
    """Scores from the posterior means.  ``arms`` are in order of their id."""
    means = np.array([a.m for a in arms]).T

    @F.arrow_udf("array<double>")
    def probabilities(x: pa.Array) -> pa.Array:
        return _as_lists(_matrix(x) @ means)

    return _entries(probabilities("x"), arms)


def scores_by_round(history: Sequence[tuple], precision: float = 1.0, draw: bool = True) -> Column:
    """Scores of every row with the arms that its own round was chosen with.

    ``history`` is that of a learning replay, so no arm has seen the round it scores.
    With ``draw`` they are the replay's own scores, otherwise those of the means.
    """
    arms = history[0][2][precision]
    by_day = {
        day: (
            np.array([a.m for a in held[precision]]).T,
            1.0 / np.array([a.q for a in held[precision]]).T,
            salts([f"{a.offer_id}|{seed}" for a in held[precision]]),
        )
        for day, seed, held in history
    }

    @F.arrow_udf("array<double>")
    def probabilities(first: pa.Array, second: pa.Array, x: pa.Array, days: pa.Array) -> pa.Array:
        rows = _matrix(x)
        one, two = (w.to_numpy(zero_copy_only=False) for w in (first, second))
        of_row = days.to_pylist()
        logits = np.zeros((len(rows), len(arms)))
        for day in set(of_row):
            at = np.array([d == day for d in of_row])
            means, variances, salt = by_day[day]
            logits[at] = rows[at] @ means
            if draw:
                logits[at] += keyed_normals(one[at], two[at], salt) * np.sqrt((rows[at] * rows[at]) @ variances)
        return _as_lists(logits)

    return _entries(probabilities(*key_words(F.col("opp_id")), F.col("x"), F.col("round_day")), arms)


def thompson_scores(arms: Sequence[Arm], seed: int = SEED) -> Column:
    """Scores from one draw of each arm's weights.

    With independent normal weights the logit itself is normal, with mean m.x
    and variance sum(x^2/q); so one draw per row and arm is enough.  It is a
    function of the row's key, so the same under any partitioning or retry.
    """
    means = np.array([a.m for a in arms]).T
    variances = 1.0 / np.array([a.q for a in arms]).T
    salt = salts([f"{a.offer_id}|{seed}" for a in arms])

    @F.arrow_udf("array<double>")
    def probabilities(first: pa.Array, second: pa.Array, x: pa.Array) -> pa.Array:
        rows = _matrix(x)
        noise = keyed_normals(*(w.to_numpy(zero_copy_only=False) for w in (first, second)), salt)
        return _as_lists(rows @ means + noise * np.sqrt((rows * rows) @ variances))

    return _entries(probabilities(*key_words(F.col("opp_id")), F.col("x")), arms)


def best_of(scores: Column, candidates: Sequence[str] | None = None) -> Column:
    """The entry with the highest score, the smallest id among equals; only of ``candidates``, if given."""
    if candidates is not None:
        scores = F.filter(scores, lambda s: s["offer_id"].isin(list(candidates)))
    return F.array_max(scores)
