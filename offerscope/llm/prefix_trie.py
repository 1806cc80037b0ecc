"""Trie of the common beginnings of conversations, by fixed-length block hashing.

1. Turns are numbered inside their conversation by a range partitioning (``number_slots``);
   from here on a turn is 128 bits of a digest of role and text, and its bytes.
2. ``BLOCK`` turns make a block.  A conversation's blocks are known by sums of hashes of all
   blocks before them, so conversations that agree up to a block boundary have equal sums.
   Grouping by (sums, block) leaves each different block once, with its number of
   conversations and the smallest of them.
3. A block without a sibling below its boundary gives its turns' nodes as they are.  Only
   where siblings diverge are the different blocks taken apart into turns and their common
   beginnings added up.
4. All nodes with the same smallest member are a path, the chain of that conversation.
   Totals of chains go up the tree of chains by pointer doubling; inside a chain they are
   running sums.  So a trie of any depth takes a logarithmic number of rounds.

No conversation, node or group is collected into a task: a block has at most ``BLOCK``
turns, running sums go in two levels (``running_sums``), counts are summed before they are
shuffled.  The checksum of a node's own conversations is SHA-256 over their sorted ids, which
is sequential by nature: ids are sorted and joined into pieces by many tasks, and one task
only runs the hash over a node's pieces, one after the other.

Nodes are told apart by 128 bits of hashes of SHA-256 digests.

Defined results: a null role or text is empty; a null turn comes before all others; turns
with equal numbers go by their digest, a fixed order; repeated turns stay; rows without a
conv_id take no part; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.sharding import number_slots
from offerscope.session import stage

BLOCK = 8
#: Rows of one group that a single window sorts in ``running_sums``.
SPAN = 4096
#: Bytes of joined ids that are handed on as one piece.
PIECE = 1 << 18
WORDS = 4


def running_sums(rows: DataFrame, group: str, index: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """Add ``prefix`` + column: the sum over all rows of ``group`` with a smaller ``index``.

    ``index`` counts from 0 without repeats.  Spans of ``SPAN`` numbers have a window each,
    and the totals of earlier spans are added, so no window runs over a whole hot group.
    """
    spans = rows.withColumn("_span", F.floor(F.col(index) / SPAN))
    inside = Window.partitionBy(group, "_span").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy(group, "_span").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "_span", *[F.sum(f"_{c}").over(earlier).alias(f"_{c}") for c in columns])
    summed = spans.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns])
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return summed.join(before.filter("_span > 0"), [group, "_span"], "left").select(
        *rows.columns, *[(zero(f"_in_{c}") + zero(f"_{c}")).alias(prefix + c) for c in columns]
    )


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest (16 bytes), n_bytes (of the text): one row per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return number_slots(turns, "conv_id", ["turn", "digest"], "pos").select("conv_id", "pos", "digest", "n_bytes")


def share_beginnings(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Give conversations the beginning of the first one of their family: (turns, conversations).

    With b = c - c mod ``family`` and h = crc32(c) mod ``most``, conversation c becomes the
    first h turns of b (fewer if b has fewer, none if there is no b), then its own from h on.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    known = stage(lengths.select("conv_id", "n", base.alias("base"), h.alias("h")), "conversations")
    heads = known.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    moved = known.join(heads, "base", "left").select(
        "conv_id", (F.least("h", F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("move")
    )
    own = (
        turns.filter(F.col("pos") >= h)
        .join(moved.filter("move <> 0"), "conv_id", "left")
        .withColumn("pos", F.col("pos") + F.coalesce("move", F.lit(0)))
        .select("conv_id", "pos", "digest", "n_bytes")
    )
    lent = (
        turns.filter((F.col("pos") < most - 1) & (F.pmod("conv_id", F.lit(family)) == 0))
        .withColumnRenamed("conv_id", "base")
        .join(known.select("conv_id", "base", "h"), "base")
        .filter("pos < h")
        .select("conv_id", "pos", "digest", "n_bytes")
    )
    return own.unionByName(lent), known.select("conv_id")


def _halves(*parts: Column) -> list[Column]:
    """``WORDS`` numbers of 32 bits, whose sums cannot overflow."""
    found = []
    for seed in range(WORDS // 2):
        h = F.xxhash64(F.lit(seed), *parts)
        found += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return found


def _node(sums: Sequence[Column], inside: Column) -> list[Column]:
    """Two hashes that name a node: the sums up to its last block boundary and the digest after it."""
    return [F.xxhash64(F.lit(seed), *sums, inside) for seed in (1, 2)]


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, block, items (array of digest, n_bytes) and sums s0.. over the blocks before it."""
    parts = (
        turns.groupBy("conv_id", F.floor(F.col("pos") / size).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("t"))
        .select("conv_id", "block", F.transform("t", lambda x: F.struct(x["digest"], x["n_bytes"])).alias("items"))
    )
    digest = F.sha2(F.aggregate("items", F.lit(b""), lambda a, x: F.concat(a, x["digest"])), 256)
    words = _halves(F.col("block"), digest)
    hashed = parts.select("*", *[w.alias(f"w{i}") for i, w in enumerate(words)])
    summed = running_sums(hashed, "conv_id", "block", [f"w{i}" for i in range(WORDS)], "s")
    return summed.withColumnsRenamed({f"sw{i}": f"s{i}" for i in range(WORDS)})


def _turns_of_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """One row per turn of each different block: a, b (its node), pa, pb (the parent), depth, n_bytes, n_convs, conv_id."""
    sums = [F.col(f"s{i}") for i in range(WORDS)]
    beyond = [F.col(f"s{i}") + F.col(f"w{i}") for i in range(WORDS)]
    empty = F.lit("")
    at = blocks.select("*", F.posexplode("items").alias("j", "item"))
    so_far = F.aggregate(F.slice("items", 1, F.col("j") + 1), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    until = F.aggregate(F.slice("items", 1, F.col("j")), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    here = [
        F.when(F.col("j") + 1 == size, full).otherwise(part)
        for full, part in zip(_node(beyond, empty), _node(sums, F.sha2(so_far, 256)))
    ]
    above = [
        F.when(F.col("j") == 0, edge).otherwise(part)
        for edge, part in zip(_node(sums, empty), _node(sums, F.sha2(until, 256)))
    ]
    return at.select(
        here[0].alias("a"),
        here[1].alias("b"),
        above[0].alias("pa"),
        above[1].alias("pb"),
        (F.col("block") * size + F.col("j") + 1).alias("depth"),
        F.col("item.n_bytes").alias("n_bytes"),
        "n_convs",
        "conv_id",
    )


def _nodes(blocks: DataFrame, size: int) -> DataFrame:
    """All nodes but the root."""
    sums = [f"s{i}" for i in range(WORDS)]
    words = [f"w{i}" for i in range(WORDS)]
    different = stage(
        blocks.groupBy("block", *sums, *words, "items")
        .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .withColumn("_id", F.monotonically_increasing_id()),
        "trie-blocks",
    )
    # a block is alone if no other block follows the same beginning
    alone = (
        different.groupBy("block", *sums)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_id"))
        .filter("n = 1")
        .select("_id", F.lit(True).alias("alone"))
    )
    marked = different.join(alone, "_id", "left")
    plain = _turns_of_blocks(marked.filter("alone"), size)
    apart = _turns_of_blocks(marked.filter("alone IS NULL"), size)
    merged = apart.groupBy("a", "b", "pa", "pb", "depth").agg(
        F.min("n_bytes").alias("n_bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    return plain.unionByName(merged)


def _ends(blocks: DataFrame, conversations: DataFrame, size: int) -> DataFrame:
    """a, b, conv_id: the node at which each conversation ends."""
    root = _node([F.lit(0).cast("long")] * WORDS, F.lit(""))
    depth = F.struct("block", *[f"s{i}" for i in range(WORDS)], *[f"w{i}" for i in range(WORDS)], "items")
    last = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    whole = F.size("items") == size
    sums = [F.col(f"s{i}") for i in range(WORDS)]
    beyond = [F.col(f"s{i}") + F.col(f"w{i}") for i in range(WORDS)]
    digest = F.sha2(F.aggregate("items", F.lit(b""), lambda a, x: F.concat(a, x["digest"])), 256)
    nodes = [F.when(whole, full).otherwise(part) for full, part in zip(_node(beyond, F.lit("")), _node(sums, digest))]
    ended = blocks.join(last, ["conv_id", "block"]).select("conv_id", *[n.alias(c) for n, c in zip(nodes, "ab")])
    return conversations.join(ended, "conv_id", "left").select(
        *[F.coalesce(c, r).alias(c) for c, r in zip("ab", root)], "conv_id"
    )


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a, b, conv_id -> a, b, first id, ids joined by commas, ``PIECE`` bytes at most."""
    open_: tuple | None = None
    ids: list[str] = []
    pieces: list[tuple] = []
    size = held = 0

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=["a", "b", "first", "ids"]
        )

    for batch in batches:
        a, b, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
            if at == stop:
                continue
            if open_ != (int(a[at]), int(b[at])):
                if open_:
                    pieces.append((*open_, int(ids[0]), ",".join(ids).encode()))
                open_, ids, size = (int(a[at]), int(b[at])), [], 0
            for one in map(str, conv[at:stop].tolist()):
                if size > PIECE:
                    pieces.append((*open_, int(ids[0]), ",".join(ids).encode()))
                    ids, size = [], 0
                ids.append(one)
                size += len(one) + 1
                held += len(one) + 1
            if held > 4 * PIECE and pieces:
                yield out()
                pieces, held = [], 0
    if open_:
        pieces.append((*open_, int(ids[0]), ",".join(ids).encode()))
        yield out()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of a, b, first, ids -> a, b, SHA-256 of each node's ids."""
    open_, running = None, None
    for batch in batches:
        done = []
        for a, b, _, ids in zip(*[batch.column(c).to_pylist() for c in range(4)]):
            if open_ == (a, b):
                running.update(b"," + ids)
                continue
            if open_:
                done.append((*open_, running.hexdigest()))
            open_, running = (a, b), hashlib.sha256(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "sha"])
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_, running.hexdigest())], names=["a", "b", "sha"])


def _chain_totals(nodes: DataFrame, measures: Sequence[str]) -> DataFrame:
    """conv_id, above (the chain it hangs on), at (the depth there) and the measures summed over
    each chain and all chains below it."""
    tops = nodes.filter("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select(
        "conv_id", F.col("parent_conv_id").alias("above"), (F.col("depth") - 1).alias("at")
    )
    own = nodes.groupBy("conv_id").agg(*[F.sum(m).alias(m) for m in measures])
    chains = stage(tops.join(own, "conv_id").withColumn("jump", F.col("above")), "chains")
    while not chains.filter("jump IS NOT NULL").isEmpty():
        # totals of all chains fewer than 2^k steps below; ``jump`` is 2^k steps above
        more = chains.filter("jump IS NOT NULL").groupBy("jump").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
        up = chains.select(F.col("conv_id").alias("jump"), F.col("jump").alias("_jump"))
        chains = stage(
            chains.join(up, "jump", "left")
            .join(more.withColumnRenamed("jump", "conv_id"), "conv_id", "left")
            .select(
                "conv_id",
                "above",
                "at",
                *[(F.col(m) + F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in measures],
                F.col("_jump").alias("jump"),
            ),
            "chains",
        )
    return chains.drop("jump")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per different beginning of the ``conversations``, whose ``turns`` (conv_id, pos
    from 0 without gaps, digest, n_bytes) may lie in any order.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    blocks = stage(_blocks(turns, block), "conversation-blocks")
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    here = _node([zero] * WORDS, F.lit(""))
    root = root.select(
        here[0].alias("a"), here[1].alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        zero.alias("depth"), zero.alias("n_bytes"), "n_convs", "conv_id",
    )
    nodes = stage(_nodes(blocks, block).unionByName(root), "trie-nodes")

    children = nodes.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    counted = nodes.join(children.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").withColumn(
        "n_children", F.coalesce("n_children", zero)
    )
    placed = stage(
        counted.join(parents, ["pa", "pb"], "left")
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
        .drop("pa", "pb", "n_bytes"),
        "trie-placed",
    )

    measures = ["n_leaves", "saved_tokens"]
    chains = _chain_totals(placed, measures)
    hung = (
        chains.filter("above IS NOT NULL")
        .groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth"))
        .agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    )
    weighted = placed.join(hung, ["conv_id", "depth"], "left").select(
        *[c for c in placed.columns if c not in measures],
        *[(F.col(m) + F.coalesce(f"_{m}", zero)).alias(m) for m in measures],
    )
    # from a chain's last node upwards: a node's subtree is itself and what is below it
    deepest = placed.groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    upwards = weighted.join(deepest, "conv_id").withColumn("up", F.col("deepest") - F.col("depth"))
    summed = running_sums(upwards, "conv_id", "up", measures, "below_")

    ends = _ends(blocks, conversations, block)
    pieces = (
        ends.repartitionByRange("a", "b", "conv_id")
        .sortWithinPartitions("a", "b", "conv_id")
        .mapInArrow(_join_ids, "a long, b long, first long, ids binary")
    )
    hashes = (
        pieces.repartition("a", "b")
        .sortWithinPartitions("a", "b", "first")
        .mapInArrow(_hash_ids, "a long, b long, sha string")
    )
    return summed.join(hashes, ["a", "b"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        *[(F.col(m) + F.col(f"below_{m}")).alias(m) for m in measures],
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
