"""Quality classifier: a byte-level convolutional network in numpy.

Layers: one filter bank over every window of ``WIDTH`` bytes (a table of weights for each
byte at each place, so a convolution is ``WIDTH`` look-ups), ReLU, the maximum over each
chunk of ``CHUNK`` bytes, chunks overlapping by half and covering the whole document, the
mean over chunks, joined by how far the text falls short of a chunk, and a logistic unit
that gives one probability.

Filters start as byte strings drawn from the training texts and are then learnt with the
rest by Adam; through a maximum only the window that won it is changed.

A share of the training texts of label 1 is cut to a few words in each epoch, so that a short text is
not taken for a poor one.  Learning takes at most ``TRAIN_ROWS`` labelled keys, each once, and ``TRAIN_CHUNKS`` chunks of each
(spread evenly over the text), about 12 MB, so it fits the driver whatever the corpus.
Scores always come from whole texts, in blocks of bounded size.

Defined results: a null or empty text is scored as one chunk of zero bytes; without
labels of both kinds every score is the share of label 1 (0.5 if there is none); repeated
rows are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.shingle_join import unused
from offerscope.llm.wordbpe import forget_encoder

TRAIN_ROWS = 3000
TRAIN_CHUNKS = 8
CHUNK = 512
WIDTH = 6
FILTERS = 32
#: Bytes that are convolved at once; with the filters' outputs, a few hundred times as much memory.
BLOCK = 1 << 16
#: Texts that are copied out of an Arrow batch at once.
COPIED = 64


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Filter outputs before ReLU for every window of ``data``."""
        n = len(data) - WIDTH + 1
        out = np.take(self.filters[0], data[:n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.filters[k], data[k : n + k], axis=0)
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.clip(pooled @ self.weights + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))


def half_chunks(net: Network, text: bytes) -> np.ndarray:
    """Maxima over consecutive half chunks of windows of one text."""
    half = CHUNK // 2
    data = np.frombuffer(text + bytes(max(0, WIDTH - len(text))), np.uint8)
    windows = len(data) - WIDTH + 1
    found = []
    step = BLOCK // half * half
    for at in range(0, windows, step):
        part = net.activations(data[at : at + step + WIDTH - 1])
        found.append(np.maximum.reduceat(part, np.arange(0, len(part), half), axis=0))
    return np.concatenate(found)


def pool(net: Network, halves: np.ndarray, size: int) -> np.ndarray:
    """Mean over overlapping chunks of the maximum in each, and how far the text falls short of a chunk."""
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    return np.append(np.maximum(chunks + net.bias, 0).mean(0), fill(size))


#: Text lengths in bytes below which a text has fewer filters at work than a whole chunk.
SHORT = (48, 128, CHUNK)


def fill(size: int) -> list[float]:
    """For each length of ``SHORT``: 0 for a text as long, up to 1 for an empty one, by the logarithm."""
    return [1 - float(np.log1p(min(size, n)) / np.log1p(n)) for n in SHORT]


def whole_texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column one after the other; a null is an empty one."""
    for at in range(0, len(column), COPIED):
        yield from (x or b"" for x in column.slice(at, COPIED).cast(pa.binary()).to_pylist())


def scores(net: Network, texts: Iterable[bytes]) -> np.ndarray:
    """Probabilities of label 1; short texts are convolved together."""
    pooled: dict[int, np.ndarray] = {}
    half, group, size = CHUNK // 2, [], 0

    def flush() -> None:
        if not group:
            return
        padded = [text + bytes(max(0, WIDTH - len(text))) for _, text in group]
        part = net.activations(np.frombuffer(b"".join(padded), np.uint8))
        cuts, owners, at = [], [], 0
        for j, data in enumerate(padded):
            windows = len(data) - WIDTH + 1
            starts = range(at, at + windows, half)
            cuts += starts
            owners.append(len(starts))
            if j < len(padded) - 1:
                cuts.append(at + windows)  # windows that run into the next text
            at += len(data)
        maxima = np.maximum.reduceat(part, np.array(cuts), axis=0)
        row = 0
        for (i, text), n in zip(group, owners):
            pooled[i] = pool(net, maxima[row : row + n], len(text))
            row += n + 1

    for i, text in enumerate(texts):
        if len(text) > BLOCK // 4:
            pooled[i] = pool(net, half_chunks(net, text), len(text))
            continue
        group.append((i, text))
        size += len(text)
        if size > BLOCK:
            flush()
            group, size = [], 0
    flush()
    rows = [pooled[i] for i in range(len(pooled))]
    return net.probability(np.array(rows, np.float64).reshape(-1, len(net.bias) + len(SHORT)))


def spread_chunks(text: bytes, most: int = TRAIN_CHUNKS) -> bytes:
    """Up to ``most`` chunks from all over the text, joined."""
    if len(text) <= most * CHUNK:
        return text
    starts = np.linspace(0, len(text) - CHUNK, most).astype(int)
    return b"".join(text[a : a + CHUNK] for a in starts)


def shortened(text: bytes, rng: np.random.Generator) -> bytes:
    """A few words from somewhere in the text."""
    size = int(8 * 2 ** (3.5 * rng.random()))
    if len(text) <= size:
        return text
    at = int(rng.integers(0, len(text) - size))
    start = text.find(b" ", at, at + 64) + 1 or at
    stop = text.find(b" ", start + size, start + size + 64)
    return text[start : stop if stop > 0 else start + size]


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zero = np.zeros(1, np.float32)
    return Network(np.zeros((WIDTH, 256, 1), np.float32), zero, np.zeros(1 + len(SHORT)), float(np.log(share / (1 - share))))


def train(texts: Sequence[bytes], labels: Sequence[int], epochs: int = 12, seed: int = 5) -> Network:
    """Fit a network to whole texts (cut by ``spread_chunks``) and 0/1 labels."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    whole = list(texts)
    texts = [t + bytes(max(0, WIDTH - len(t))) for t in whole]
    filters = rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32)
    by_label = [np.flatnonzero(y == v) for v in (0, 1)]
    for f in range(FILTERS):  # half of the filters from texts of either label
        text = texts[rng.choice(by_label[f % 2])]
        at = int(rng.integers(0, len(text) - WIDTH + 1))
        filters[np.arange(WIDTH), np.frombuffer(text[at : at + WIDTH], np.uint8), f] += 0.5
    net = Network(filters, np.full(FILTERS, -0.5, np.float32), np.append(rng.normal(0, 0.1, FILTERS), np.zeros(len(SHORT))), 0.0)
    params = [net.filters, net.bias, net.weights, np.zeros(1)]
    params[3][0] = float(np.log(y.mean() / (1 - y.mean())))
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    half, step = CHUNK // 2, 0
    batches = max(1, -(-len(texts) // 32))
    for _ in range(max(epochs, -(-300 // batches))):
        order = rng.permutation(len(texts))
        for chosen in np.array_split(order, batches):
            grads = [np.zeros(p.shape) for p in params]
            for i in chosen:
                text = shortened(whole[i], rng) if y[i] and rng.random() < 0.1 else whole[i]
                data = np.frombuffer(text + bytes(max(0, WIDTH - len(text))), np.uint8)
                part = net.activations(data)
                n_halves = -(-len(part) // half)
                starts = [(a * half, min((a + 2) * half, len(part))) for a in range(max(1, n_halves - 1))]
                winners = np.array([a + part[a:b].argmax(0) for a, b in starts])
                values = part[winners, np.arange(FILTERS)] + net.bias
                pooled = np.append(np.maximum(values, 0).mean(0), fill(len(text)))
                error = float(net.probability(pooled)) - y[i]
                grads[2] += error * pooled
                grads[3] += error
                down = np.where(values > 0, error * net.weights[:FILTERS] / len(starts), 0)
                grads[1] += down.sum(0)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (data[winners + k], np.arange(FILTERS)), down)
            step += 1
            rate = 0.02 * min(1, step / 20)
            for p, g, (m, v) in zip(params, grads, moments):
                g = g / len(chosen) + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
            net.offset = float(params[3][0])
    return net


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    key: str,
    text: str,
    allowed: Callable[[str], Column],
    rows: int = TRAIN_ROWS,
) -> tuple[list[bytes], list[int]]:
    """Texts (cut) and labels of up to ``rows`` keys that are ``allowed``, labelled and in ``docs``, chosen by a hash of the key.

    A key counts once, with the label that most of its rows have (0 if even) and the first of its texts.
    """
    present = docs.select(F.col(key).cast("long").alias("_key")).distinct()
    chosen = (
        labels.select(F.col(key).cast("long").alias("_key"), F.col(target).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1))
        .filter(allowed("_key"))
        .groupBy("_key")
        .agg((F.avg("_label") > 0.5).cast("int").alias("_label"))
        .join(present, "_key", "left_semi")
        .select("_key", "_label")
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(rows)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            texts = [spread_chunks(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=["_key", "_label", "part"])

    # at most ``rows`` rows of two numbers, so the broadcast is bounded
    joined = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(chosen), "_key")
    found = (
        joined.select("_key", "_label", "_text")
        .mapInArrow(cut, "_key long, _label int, part binary")
        .groupBy("_key", "_label")
        .agg(F.min("part").alias("part"))
        .orderBy(F.xxhash64("_key"), "_key")
        .collect()
    )
    return [bytes(r["part"]) for r in found], [r["_label"] for r in found]


def score(
    docs: DataFrame, net: Network, text: str = "text", keep: Sequence[str | Column] = ("doc_id",), name: str = "score"
) -> DataFrame:
    """``keep`` columns and the probability of label 1 of every whole text.

    A text that is kept is sent to the workers once.
    """
    kept = docs.select(*keep)
    width = len(kept.columns)
    plain = [c if isinstance(c, str) else None for c in keep]
    if text in plain and len(plain) == width and docs.schema[text].dataType == T.StringType():
        place, sent = plain.index(text), kept
    else:
        place, sent = width, docs.select(*keep, F.col(text).cast("binary").alias(unused(kept, "_whole_text")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            found = scores(net, whole_texts(batch.column(place)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(found, pa.float64())], names=[*batch.schema.names[:width], name]
            )

    schema = T.StructType([*kept.schema.fields]).add(name, T.DoubleType())
    return sent.mapInArrow(judge, schema)
