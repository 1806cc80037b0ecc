"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams.  A document's own most
frequent n-grams are compared with every profile by out-of-place distance: the difference
of the two ranks, or the length of a profile for an n-gram that the profile lacks.

Texts are lower-cased; runs of anything but letters are one space; n-grams have one to
three characters.  Counts for the profiles come from all rows that may be learnt from: each
task counts its rows, Spark adds up, and only ``size`` n-grams per language reach the driver.
Counting takes a long text in blocks, so memory does not grow with it.

Defined results: a null text, and a text without a letter, is ``und`` with score 0; so is
everything if nothing can be learnt.  Equal frequencies rank by n-gram code, equal
distances by language name.  Repeated rows are judged one by one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.shingle_join import unused

#: N-grams in a profile.
PROFILE_SIZE = 300
#: Characters that are counted at once.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Stands for a gap in codes; no letter has this code point.
GAP = 1

Counts = tuple[np.ndarray, np.ndarray]


class NGrams:
    """Counts of n-grams as 63-bit codes: 21 bits a character, ``GAP`` for a gap between words."""

    def __init__(self, longest: int = 3):
        self.longest = longest
        self.letter = np.array([chr(i).isalpha() for i in range(1 << 16)])

    def letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        high = points >= 1 << 16
        keep = self.letter[np.where(high, 0, points)]
        if high.any():
            values, where = np.unique(points[high], return_inverse=True)
            keep[high] = np.array([chr(v).isalpha() for v in values])[where]
        return np.where(keep, points, 0)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of all n-grams of letters with single gaps, of which at least one is a letter."""
        found = [points[points > 0]]
        code = points = np.where(points > 0, points, GAP)
        for n in range(1, self.longest):
            code = code[:-1] | points[n:] << (21 * n)
            found.append(code)
        return np.concatenate(found)

    def count(self, text: str) -> Counts:
        """Sorted codes and their counts."""
        total: Counts = (np.empty(0, np.int64), np.empty(0, np.int64))
        lap = np.zeros(1, np.int64)  # the characters before a block that its n-grams need
        begun = False
        for at in range(0, max(len(text), 1), BLOCK):
            points = self.letters(text[at : at + BLOCK])
            if at + BLOCK >= len(text):
                points = np.append(points, 0)
            before = np.r_[lap[-1], points[:-1]]
            points = points[(points > 0) | (before > 0)]
            joined = np.concatenate([lap, points])
            found = self.codes(joined)
            if begun and len(lap) > 0:
                # n-grams inside the overlap were counted with the last block
                seen = np.sort(self.codes(lap))
                values, n = np.unique(found, return_counts=True)
                again, m = np.unique(seen, return_counts=True)
                n[np.searchsorted(values, again)] -= m
            else:
                values, n = np.unique(found, return_counts=True)
            total = merge([total, (values[n > 0], n[n > 0])])
            lap, begun = joined[-(self.longest - 1) :], True
        return total


def merge(parts: Sequence[Counts]) -> Counts:
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def top(counts: Counts, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    codes, n = counts
    if len(codes) > 4 * size:  # drop what is rarer than the last that can get in
        least = np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:size]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """A profile for each language of ``docs``, from all its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, pending, held = NGrams(), {}, 0
        done: dict[str, Counts] = {}

        def settle() -> None:
            for language, parts in pending.items():
                done[language] = merge([done[language], *parts] if language in done else parts)
            pending.clear()

        for batch in batches:
            for language, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = grams.count(whole.as_py())
                pending.setdefault(language, []).append(found)
                held += len(found[0])
                if held > 2_000_000:
                    settle()
                    held = 0
        settle()
        for language, (codes, n) in sorted(done.items()):
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([language] * len(codes), pa.string()), "code": pa.array(codes), "n": pa.array(n)}
            )

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "code", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


class Profiles:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(profiles[name], np.int64))
            self.ranks[at, j] = np.arange(len(at))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The language of the smallest distance, and 1 less that distance as a part of the largest possible."""
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = self.ranks[at[known]]
        apart = np.abs(ranks - np.flatnonzero(known)[:, None])
        distance = np.where(ranks < 0, self.size, apart).sum(0) + self.size * np.count_nonzero(~known)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    text: str = "text",
    keep: Sequence[str | Column] = ("doc_id",),
    size: int = PROFILE_SIZE,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` columns, the language and 1 less its relative distance."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = NGrams(), Profiles(profiles, size)
        for batch in batches:
            found = [known.nearest(top(grams.count(x.as_py() or ""), size)) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=[*batch.schema.names[:-1], *names],
            )

    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields]).add(names[0], T.StringType()).add(names[1], T.DoubleType())
    return docs.select(*keep, F.col(text).alias(unused(kept, "_whole_text"))).mapInArrow(judge, schema)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter, as the n-grams count letters."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in batches:
            found = [len(grams.count(x.as_py() or "")[0]) > 0 for x in batch.column(batch.num_columns - 1)]
            kept = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield kept.filter(pa.array(found, pa.bool_()))

    return docs.select("*", F.col(text).alias(unused(docs, "_whole_text"))).mapInArrow(judge, docs.schema)
