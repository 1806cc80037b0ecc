"""Jaccard self-join of documents on word n-grams: tiles, bitmap bounds, exact intersections.

1. Every text becomes the sorted array of its distinct shingle hashes (64 bits).  Only its
   size, a 128-bit digest and ``BANDS`` tile keys are kept.  A key is made of two minima of
   the set under random orders.  Sets that are equal are one class from here on.
2. Classes that share a key form a tile.  Each class is first compared with the smallest
   class it shares a tile with; most copies of one text are connected by that.
3. Tiles whose classes are still in different components are cut into blocks by bands of set
   sizes.  Block by block, size bounds and then the bits of hashed bitmaps bound the overlap
   from above: ``|A & B| <= (|A| + |B| - bits that differ) / 2``.
4. Pairs that pass are verified by intersecting the sorted arrays, those of the best bounds
   first.  What they connect is not compared again; the classes of the other pairs go on to
   later steps, until none is left.

Two sets with Jaccard similarity s share a tile unless all keys differ, (1 - s^2)^BANDS: 5e-15
at 0.75, less above it.  Everything after that is exact, but for hashes: different tiles are
told apart by 128 bits and more (``distinct_tiles``).  No bucket, partner or candidate is
capped, and no pair inside a component is lost to the class result.

Texts are shuffled once, to pick out those of classes that share a tile; after that only
these move.  A block's maps have at most ``BLOCK_BYTES`` or so, whatever the size of a tile and of
its texts; the component with most members in a tile is never compared with itself
(``block_rows``).

Defined results: a null text or one without a word has no shingles, and links with nothing;
with fewer than ``n`` words the whole sequence is the one shingle; equal sets link; a row with
a null key is linked like any other, and its component is the smallest key that is not null
(null if there is none); repeated rows are equal sets; an empty table gives an empty result; other columns, whatever
their names, are ignored, and kept as they are by ``one_per_component``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm.components import components
from offerscope.session import stage

BANDS = 40
#: Bytes of bitmaps, by the sizes of their sets, that make a block, and what a small map counts
#: for, so that a block has at most 4096 classes.
BLOCK_BYTES = 1 << 22
LEAST_BYTES = 1 << 10
#: The band of members that are not at home, if they all fit a block.
POOLED = -1
#: Of the partners that a class may link with in a block, ranked by their bound, so many are
#: verified together in each step; the last step takes all the rest.
STEPS = (2, 16, 128, None)
SEED = 11


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of shingle hashes and what is derived from them."""

    def __init__(self, n: int, bands: int = BANDS):
        self.n = n
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        rng = np.random.default_rng(SEED)
        draw = lambda k: rng.integers(1, 1 << 63, k, dtype=np.int64).astype(U) | U(1)
        self.base, self.places = draw(1)[0], draw(max(n, 2))
        self.orders, self.flips = draw(2 * bands)[:, None], draw(2 * bands)[:, None]
        self.powers = np.ones(1, U)

    def shingles(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text.lower(), np.uint8)  # A to Z only
        inside = ~self.space[data]
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(data) else np.empty(0, int)
        if not len(starts):
            return np.empty(0, U)
        sizes = np.diff(np.r_[starts, len(data)])
        longest = int(sizes.max())
        if len(self.powers) < longest:
            self.powers = np.multiply.accumulate(np.r_[U(1), np.full(2 * longest, self.base, U)])
        place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
        letters = np.where(inside[starts[0] :], data[starts[0] :].astype(U) + U(1), U(0))
        words = mix(np.add.reduceat(letters * self.powers[place], starts - starts[0]))
        if len(words) < self.n:
            together = np.array([len(words)], U)
            for k in range(len(words)):
                together = mix((together ^ words[k : k + 1]) * self.places[:1])
            return together
        count = len(words) - self.n + 1
        total = words[:count] * self.places[0]
        for k in range(1, self.n):
            total = total + words[k : count + k] * self.places[k]
        return np.unique(mix(total))

    def keys(self, found: np.ndarray) -> np.ndarray:
        """One key per band; none for sets of fewer than two, which have only equal partners."""
        if len(found) < 2:
            return np.empty(0, np.int64)
        least = np.full(len(self.orders), ~U(0))
        for at in range(0, len(found), 512):
            part = (found[None, at : at + 512] ^ self.flips) * self.orders
            np.minimum(least, part.min(1), out=least)
        bands = np.arange(len(self.orders) // 2, dtype=U)
        return mix(mix(least[::2]) * self.places[0] + mix(least[1::2]) + bands).view(np.int64)


def bitmap(found: np.ndarray, log_bits: int) -> np.ndarray:
    """The set hashed into 2^log_bits bits."""
    bits = np.zeros(1 << log_bits, bool)
    bits[(found >> U(64 - log_bits)).astype(np.int64)] = True
    return np.packbits(bits)


def fold(bits: np.ndarray, log_bits: int) -> np.ndarray:
    """A bitmap made shorter: neighbouring bits are joined by or."""
    flat = np.unpackbits(bits)
    return np.packbits(flat.reshape(1 << log_bits, -1).any(1))


def bits_for(size: int) -> int:
    """Logarithm of the bits of a set's map: 8 to 16 bits an element, so that few differences hide."""
    return max(6, int(8 * size - 1).bit_length())


def linked(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """Exact test on sorted arrays: whole * |A & B| >= part * |A | B|."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[at] == a))
    return whole * common >= part * (len(a) + len(b) - common)


def _describe(n: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(batch.num_columns - 1):
                found = shingler.shingles(text.as_py() or b"")
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(shingler.keys(found))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=[*batch.schema.names[:-1], "n", "digest", "keys"],
            )

    return describe


def _verify(n: int, part: int, whole: int):
    """Rows of a, b and their two texts -> the pairs that link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n, 1)
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, U))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                first = x.as_py()
                if first != last[0]:  # rows of one partner mostly follow each other
                    last = (first, shingler.shingles(first))
                ok.append(linked(last[1], shingler.shingles(y.as_py()), part, whole))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"]
            )

    return verify


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")


def sorted_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``width`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for c in range(width):
            values = batch.column(c).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(c)[-1].as_py() != values[0]:
                changed[0] = True
        cuts = np.flatnonzero(changed).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _folded(n: np.ndarray, bits: list[np.ndarray], rows: np.ndarray, log_bits: int) -> np.ndarray:
    """The maps of ``rows`` at one length, as a matrix."""
    out = np.empty((len(rows), (1 << log_bits) // 8), np.uint8)
    for i, k in enumerate(rows):
        out[i] = bits[k] if len(bits[k]) == out.shape[1] else fold(bits[k], log_bits)
    return out


BOUNDED = "a long, b long, tile long, i long, j long, side long"


def _bound(part: int, whole: int, high: int | None):
    """Sorted rows of tile, i, j, node, side, component, now, n, bits, tiles -> pairs whose bound lets them link.

    ``tiles`` are all that a class is in: a pair comes out in the first that both share only.
    For each class its partners in other components are ranked by their bound; pairs of the first
    ``high`` ranks come out as a, b, unless they are connected by ``now``.  Both classes of a pair
    that is ranked later come out as a with their block, for the next step; there those that
    are connected by then fall out of the ranking.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 3):
            get = lambda name: table.column(name).to_numpy()
            order = np.argsort(get("n"), kind="stable")
            node, side, component, now, n = (get(c)[order] for c in ("node", "side", "component", "now", "n"))
            if (now == now[0]).all():
                continue
            later = np.zeros(len(node), bool)
            across = bool(get("i")[0] != get("j")[0])  # of two blocks: only between them
            bits = table.column("bits").to_pylist()
            bits = [np.frombuffer(bits[k], np.uint8) for k in order]
            tile = int(get("tile")[0])
            tiles = table.column("tiles").to_pylist()
            tiles = [set(tiles[k]) for k in order]
            stop = np.searchsorted(n, n * whole // part, "right")
            found_a, found_b = [], []
            # sizes of a pair differ by a third at most, so the smaller set's length of map
            # concerns a run of rows, folded to it once
            lengths = np.array([bits_for(int(x)) for x in n])
            for log_bits in np.unique(lengths):
                own = np.flatnonzero(lengths == log_bits)
                first, last = int(own[0]), int(stop[own[-1]])
                maps = _folded(n, bits, np.arange(first, last), int(log_bits))
                for k in own[own < len(node) - 1]:
                    others = np.arange(k + 1, stop[k])
                    others = others[(component[others] != component[k]) & (now[others] != now[k])]
                    if across:
                        others = others[side[others] != side[k]]
                    if not len(others):
                        continue
                    apart = np.bitwise_count(maps[others - first] ^ maps[k - first]).sum(1, dtype=np.int64)
                    overlap = (n[k] + n[others] - apart) // 2
                    may = whole * overlap >= part * (n[k] + n[others] - overlap)
                    likeness = overlap[may] / (n[k] + n[others[may]] - overlap[may])
                    good = others[may][np.lexsort((node[others[may]], -likeness))]
                    good = np.array([o for o in good if min(tiles[k] & tiles[o]) == tile], np.int64)
                    if high is not None and len(good) > high:
                        later[k] = True
                        later[good[high:]] = True
                        good = good[:high]
                    found_a += [node[k]] * len(good)
                    found_b += node[good].tolist()
            pairs, waiting = len(found_a), int(later.sum())
            block = [np.full(waiting, get(c)[0]) for c in ("tile", "i", "j")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found_a + node[later].tolist(), pa.int64()),
                    pa.array(found_b + [None] * waiting, pa.int64()),
                    *[pa.array([None] * pairs + x.tolist(), pa.int64()) for x in (*block, side[later])],
                ],
                names=["a", "b", "tile", "i", "j", "side"],
            )

    return bound


def _bitmaps(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n, 1)
        for batch in batches:
            found = [shingler.shingles(x.as_py()) for x in batch.column(1)]
            bits = [bitmap(f, bits_for(len(f))).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["node", "bits"])

    return make


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``node`` and ``component`` of all nodes, those without an edge included."""
    return nodes.join(found, "node", "left").select(
        *nodes.columns, F.coalesce("root", "node").alias("component")
    )


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until it is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(key: str, text: str) -> Column:
    """128 bits of key and text, by which narrow results find their rows again."""
    parts = F.col(key), F.col(text).cast("binary")
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def distinct_tiles(placed: DataFrame) -> DataFrame:
    """tile and size of the tiles of ``placed`` (tile, node, component) that hold several
    components; of tiles with the same nodes, the smallest.

    Tiles count as the same if they agree in size, least and greatest node and 128 bits: sums
    of the halves of two hashes with different seeds.  The sums cannot overflow.
    """
    hashes = F.xxhash64("node"), F.xxhash64(F.lit(1), "node")
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    marks = ["size", "least", "greatest", *[f"sum{i}" for i in range(len(halves))]]
    return (
        placed.groupBy("tile")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count(F.lit(1)).alias("size"),
            F.min("node").alias("least"),
            F.max("node").alias("greatest"),
            *[F.sum(half).alias(f"sum{i}") for i, half in enumerate(halves)],
        )
        .filter("low < high")
        .groupBy(*marks)
        .agg(F.min("tile").alias("tile"))
        .select("tile", "size")
    )


def block_rows(placed: DataFrame, part: int, whole: int, limit: int) -> DataFrame:
    """Rows (tile, i, j, node, side) of ``placed`` (tile, node, component, n): two nodes of one tile, in
    different components and of sizes that may link, meet in one block (tile, i, j).

    A tile whose maps fit a block is one.  In a larger one the component with most members is at
    home.  Members go into cells by home or not, by a band of sizes and, where a cell is too
    large, by a hash.  Bands are so wide that only neighbours can link; the members that are not
    at home are one cell if they fit a block.  A cell at home meets only cells that are not, so
    members at home go out once, and the few others once for each cell that they may link with.
    Nothing is compared inside the home component: the rows grow with a tile's members, not with
    their square.
    """
    width = math.log(whole / part) * 1.0001 if part < whole else 1.0
    sized = placed.withColumn("bytes", F.greatest(F.lit(LEAST_BYTES), 2 * F.col("n")))
    totals = sized.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
    tiles = totals.groupBy("tile").agg(
        F.sum("bytes").alias("total"), F.max(F.struct("m", F.col("component").alias("home"), "bytes")).alias("h")
    )
    in_tile = sized.join(tiles.select("tile", "total", "h.home", (F.col("total") - F.col("h.bytes")).alias("away")), "tile")
    small = in_tile.filter(F.col("total") <= limit)
    large = stage(
        in_tile.filter(F.col("total") > limit).select(
            "tile",
            "node",
            "bytes",
            (F.col("component") == F.col("home")).alias("home"),
            F.when((F.col("component") != F.col("home")) & (F.col("away") <= limit), POOLED)
            .otherwise(F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
            .alias("band"),
        ),
        "large-tiles",
    )
    cells = large.groupBy("tile", "home", "band").agg(F.ceil(F.sum("bytes") / limit).cast("int").alias("parts"))
    partners = cells.select("tile", *[F.col(c).alias(f"_{c}") for c in ("home", "band", "parts")])
    # at most a few bands either way: cells of a tile, not members, are paired here
    meets = (
        cells.join(partners, "tile")
        .filter(f"NOT (home AND _home) AND (abs(band - _band) <= 1 OR {POOLED} IN (band, _band))")
        .groupBy("tile", "home", "band", "parts")
        .agg(F.collect_list(F.struct("_home", "_band", "_parts")).alias("meets"))
    )
    code = lambda home, band, at: (F.col(band) * 2 + F.col(home).cast("int")).cast("long") * (1 << 32) + at
    spread = (
        large.join(meets, ["tile", "home", "band"])
        .withColumn("side", code("home", "band", F.pmod(F.xxhash64("node"), F.col("parts"))))
        .select("tile", "node", "side", F.explode("meets").alias("meet"))
        .select("tile", "node", "side", "meet.*")
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("other", code("_home", "_band", F.col("at")))
    )
    zero = F.lit(0).cast("long")
    return small.select("tile", zero.alias("i"), zero.alias("j"), "node", zero.alias("side")).unionByName(
        spread.select("tile", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side")
    )


def jaccard_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    part: int = 75,
    whole: int = 100,
) -> DataFrame:
    """For every row: _key, _hash (``row_hash``), n (size of its set) and component (null for
    an empty set); sets link from similarity part / whole on."""
    rows = docs.select(
        F.col(key).alias("_key"), row_hash(key, text).alias("_hash"), F.col(text).cast("binary").alias("_text")
    )
    described = T.StructType(
        [
            T.StructField("_key", rows.schema["_key"].dataType),
            T.StructField("_hash", rows.schema["_hash"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )
    sets = stage(rows.mapInArrow(_describe(n), described), "sets")
    classes = stage(
        sets.filter("n > 0")
        .groupBy("digest")
        .agg(F.first(F.struct("_hash", "n", "keys")).alias("s"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "s.*"),
        "classes",
    )

    in_bands = classes.select("node", F.explode("keys").alias("tile"))
    tiles = in_bands.groupBy("tile").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"))
    members = stage(
        in_bands.join(tiles.filter("leader < last").select("tile", "leader", "size"), "tile"), "tile-members"
    )
    wanted = members.groupBy("node").agg(F.min("leader").alias("leader"))
    pointers = classes.select("node", "_hash").join(wanted, "node")
    texts = stage(
        rows.select("_hash", "_text").join(pointers, "_hash").groupBy("node", "leader").agg(F.first("_text").alias("text")),
        "tile-texts",
    )
    nearest = texts.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("text").alias("text_b"))
    leaders = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    first_links = stage(
        nearest.join(leaders, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, part, whole), "a long, b long"),
        "links",
    )
    first_roots = stage(_rooted(texts.select("node"), components(first_links)), "roots")

    sizes = classes.select("node", "n")
    sketches = texts.select("node", "text").mapInArrow(_bitmaps(n), "node long, bits binary").join(sizes, "node")
    # tiles that still hold several components; of tiles with the same classes, one
    placed = members.select("tile", "node").join(first_roots, "node")
    open_tiles = stage(distinct_tiles(placed), "open-tiles")
    in_blocks = stage(
        block_rows(placed.join(open_tiles, "tile").join(sizes, "node"), part, whole, BLOCK_BYTES), "tile-blocks"
    )
    shared = in_blocks.select("node", "tile").distinct().groupBy("node").agg(F.collect_list("tile").alias("tiles"))
    sketches = stage(sketches.join(shared, "node"), "bitmaps")
    roots_ = first_roots.withColumn("now", F.col("component"))
    for high in STEPS:
        found = stage(
            in_blocks.join(sketches.join(roots_, "node"), "node")
            .select("tile", "i", "j", "node", "side", "component", "now", "n", "bits", "tiles")
            .repartition("tile", "i", "j")
            .sortWithinPartitions("tile", "i", "j")
            .mapInArrow(_bound(part, whole, high), BOUNDED),
            "bounded-pairs",
        )
        pairs = found.filter("b IS NOT NULL").select("a", "b").distinct()
        links = stage(
            _with_texts(pairs, texts.select("node", "text")).mapInArrow(_verify(n, part, whole), "a long, b long"), "links"
        )
        now = roots_.select("node", "now")
        met = links.join(now.select(F.col("node").alias("a"), F.col("now").alias("x")), "a").join(
            now.select(F.col("node").alias("b"), F.col("now").alias("y")), "b"
        )
        merged = components(met.select(F.col("x").alias("a"), F.col("y").alias("b")))
        roots_ = stage(
            roots_.join(merged.select(F.col("node").alias("now"), "root"), "now", "left").select(
                "node", "component", F.coalesce("root", "now").alias("now")
            ),
            "roots",
        )
        # only classes with pairs that are still to be looked at go on
        in_blocks = found.filter("b IS NULL").select("tile", "i", "j", F.col("a").alias("node"), "side")
        if in_blocks.isEmpty():
            break
    roots_ = roots_.select("node", F.col("now").alias("component"))
    of_class = classes.select("node", "digest").join(roots_, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component")
    )

    return sets.select("_key", "_hash", "n", "digest").join(of_class, "digest", "left").drop("digest")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """key, n_shingles and component_id of every row; options as in ``jaccard_classes``."""
    rows = jaccard_classes(docs, key, text, **options)
    smallest = rows.filter("n > 0").groupBy("component").agg(F.min("_key").alias("component_id"))
    return rows.join(smallest, "component", "left").select(
        F.col("_key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The row of the smallest key of every component, and all rows without shingles; all
    columns.  Of rows with equal key and text the smallest by their other columns stays."""
    rows = jaccard_classes(docs, key, text, **options)
    first = rows.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("_key").isNull().alias("last"), "_key", "_hash")).alias("kept")
    )
    kept = first.select(F.col("kept._hash").alias("_hash")).unionByName(rows.filter("n = 0").select("_hash"))
    mark = unused(docs, "_hash")
    hashed = docs.withColumn(mark, row_hash(key, text)).join(kept.withColumnRenamed("_hash", mark), mark, "left_semi")
    # maps have no order of their own
    order = [F.to_json(c) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (key, text)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    smallest = F.min_by(row, F.struct(*order)) if order else F.first(row)
    return hashed.groupBy(mark).agg(smallest.alias("row")).select("row.*")
