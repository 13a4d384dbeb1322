"""The prefix trie of conversations by truncation peeling.

A node of depth d is a sequence of d turns (role, text), told apart by a chained digest; the root has no turn. Peeling starts at the
deepest level: conversations that end there are merged with the nodes that survived from below, a node's counts are then complete, its
last turn is stripped, and nodes that are now alike become one parent, to which each child adds its members, leaves and savings. So
every node is found and aggregated in the same pass, and no list of a node's members is ever kept.

Equal conversations are merged first. What is left is cut into blocks, each the subtree below one prefix, small enough for a task
(`BLOCK` turns, or up to `FEW` sequences of any length); a block is peeled whole where it lies. A prefix with a bigger subtree, such as an
opening that a third of all conversations share, is cut at twice the depth, and so on. The levels above the blocks are peeled one by one with
Spark aggregates, which combine before the shuffle, so that no hot prefix meets in one task. The hash of the members that end at a node is
fed from sorted rows, one at a time, as it depends on all of them in order.

Turns are ordered by turn (null first), equal turns by role and then by the digest of role and text. Null roles and texts are empty ones.
Rows without a conversation id belong to no conversation. Repeated rows are repeated turns. A text travels as its digest only, whatever
its length; a task holds some 300 bytes for each turn of a block. An empty table gives no node, not even the root. Only the four named
columns are read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import settle, ship

from .common import in_quotes, per_batch

BLOCK = 100_000
FEW = 50
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def own_turns(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): per conversation the digests and text lengths of its turns, in order."""
    role, text = (F.coalesce(F.col(in_quotes(c)).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = talks.select(F.col(in_quotes(conv_col)).cast("bigint").alias("conv_id"), F.col(in_quotes(turn_col)).alias("turn"), role.alias("role"),
                        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
                        F.char_length(text).cast("bigint").alias("size")).filter("conv_id IS NOT NULL")
    placed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "size"))).alias("turns"))
    return placed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def with_shared_heads(own: DataFrame, group: int = 100, spread: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns come from the first conversation of the id's group of `group`, h = crc32(id) % `spread`."""
    own = settle(own)
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = own.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, spread - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % spread).cast("int")
    joined = own.withColumn("base", base).join(heads, "base", "left")
    tail = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), tail).otherwise(F.concat(F.slice("head", F.lit(1), h), tail)).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, key, path, sizes): `path` has a digest of `WIDTH` bytes for each of the prefixes, `key` is the last of them."""
    def work(batch):
        out = {"conv_id": batch.column("conv_id"), "depth": [], "key": [], "path": [], "sizes": batch.column("sizes")}
        for digests in batch.column("digests").to_pylist():
            key, path = b"", []
            for digest in digests:
                key = hashlib.sha256(key + digest).digest()[:WIDTH]
                path.append(key)
            out["depth"].append(len(path))
            out["key"].append(key)
            out["path"].append(b"".join(path))
        return out
    rows = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    return per_batch(rows, lambda: work, "conv_id bigint, depth bigint, key binary, path binary, sizes array<bigint>", rows=200)


def hashed_ends(seqs: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ids, ascending, of the conversations that are exactly the sequence `key`."""
    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k == key:
                    digest.update(b",%d" % conv)
                    continue
                if key is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])
    rows = seqs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(run, "key binary, ends_sha256 string")


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(key, depth, path, sizes, conv_id, n_convs, ends_sha256) for each sequence that some conversation is."""
    alike = seqs.groupBy("key", "depth").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"),
                                             F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    return alike.join(hashed_ends(seqs), "key")


def prefix_key(depth: Column | int) -> Column:
    """The key of the prefix of that depth, the empty one for the root."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    start = (F.greatest(depth - 1, F.lit(0)) * WIDTH + 1).cast("int")
    return F.when(depth > 0, F.col("path").substr(start, F.lit(WIDTH))).otherwise(F.lit(b""))


def blocks(units: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The sequences in blocks (`block`, the prefix of depth `at`), those that end above any block, and the deepest `at`."""
    inside, above, todo, at = [], [], units, 1
    while True:
        above.append(todo.filter(F.col("depth") < at))
        todo = todo.filter(F.col("depth") >= at).withColumn("at", F.lit(at).cast("bigint")).withColumn("block", prefix_key(at))
        size = todo.groupBy("block").agg(F.sum("depth").alias("turns"), F.count("*").alias("n"))
        heavy = settle(size.filter((F.col("turns") > BLOCK) & (F.col("n") > FEW)).select("block"))
        inside.append(todo.join(heavy, "block", "left_anti"))
        if heavy.isEmpty():
            break
        todo = settle(todo.join(heavy, "block", "left_semi").drop("at", "block"))
        at *= 2
    both = [parts[0] for parts in (inside, above)]
    for i, parts in enumerate((inside, above)):
        for part in parts[1:]:
            both[i] = both[i].unionByName(part)
    return both[0], both[1], at


class Node:
    __slots__ = ("path", "sizes", "at", "conv", "n", "children", "leaves", "saved", "ends", "kids")

    def __init__(self, path: bytes, sizes: list[int], at: int) -> None:
        self.path, self.sizes, self.at = path, sizes, at
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.kids = None, 0, 0, 0, 0, NO_ENDS, []

    def add(self, conv: int, n: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)


def peeled(units: list[dict]):
    """(node, depth, parent's conversation or None) for all nodes of whole blocks, from the deepest level up to each block's top."""
    ended = defaultdict(list)
    for unit in units:
        ended[unit["depth"]].append(unit)
    live: dict[bytes, Node] = {}
    for depth in range(max(ended, default=0), 0, -1):
        for unit in ended[depth]:
            node = live.setdefault(unit["key"], Node(unit["path"], unit["sizes"], unit["at"]))
            node.add(unit["conv_id"], unit["n_convs"])
            node.ends = unit["ends_sha256"]
        above: dict[bytes, Node] = {}
        for node in live.values():
            for kid in node.kids:
                yield kid, depth + 1, node.conv
            node.kids = []
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.sizes[depth - 1]
            if depth == node.at:
                yield node, depth, None
                continue
            key = node.path[WIDTH * (depth - 2):WIDTH * (depth - 1)]
            up = above.get(key)
            if up is None:
                up = above[key] = Node(node.path, node.sizes, node.at)
            up.add(node.conv, node.n)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.kids.append(node)
        live = above


NODES = ("depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
         "ends_sha256 string, path binary, sizes array<bigint>")


def peel_blocks(inside: DataFrame) -> DataFrame:
    """The nodes of all blocks; the block tops keep `path` and `sizes` and have no parent yet."""
    schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.binary()),
                        ("sizes", pa.list_(pa.int64()))])

    def rows_of(units):
        out = [[] for _ in schema]
        for node, depth, parent in peeled(units):
            top = depth == node.at
            for column, value in zip(out, (depth, node.conv, parent, node.n, node.children, node.leaves, node.saved, node.ends,
                                           node.path[:WIDTH * depth] if top else None, node.sizes[:depth] if top else None)):
                column.append(value)
            if len(out[0]) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    def run(batches):
        held, turns, block = [], 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for unit in batch.slice(start, 200).to_pylist():
                    if unit["block"] != block and turns > BLOCK:        # only whole blocks are peeled
                        yield from rows_of(held)
                        held, turns = [], 0
                    block = unit["block"]
                    held.append(unit)
                    turns += unit["depth"]
        yield from rows_of(held)

    columns = ["block", "at", "depth", "key", "path", "sizes", "conv_id", "n_convs", "ends_sha256"]
    return inside.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(run, NODES)


def peel_levels(tops: DataFrame, above: DataFrame, deepest: int) -> list[DataFrame]:
    """The nodes of the levels from `deepest` up to the root: `tops` are the blocks' tops, `above` the sequences that end at no block."""
    columns = ["depth", "key", "path", "sizes", "conv_id", *COUNTS, "ends_sha256"]
    zero = F.lit(0).cast("bigint")
    tops = tops.withColumn("key", prefix_key(F.col("depth")))
    ending = above.select("depth", "key", "path", "sizes", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"),
                          zero.alias("saved_tokens"), "ends_sha256")
    levels, below = [], None
    for depth in range(deepest, -1, -1):
        parts = ending.filter(F.col("depth") == depth)
        if below is not None:
            stripped = below.select(F.lit(depth).cast("bigint").alias("depth"), prefix_key(depth).alias("key"),
                                    F.substring("path", 1, WIDTH * depth).alias("path"), F.slice("sizes", 1, depth).alias("sizes"), "conv_id", "n_convs",
                                    F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
            parts = parts.unionByName(stripped)
        merged = parts.groupBy("depth", "key").agg(
            F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in COUNTS],
            F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"))
        last = F.element_at("sizes", -1) if depth else zero
        whole = (merged.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))
                 .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * last))
        below = settle(whole.select(*columns).unionByName(tops.filter(F.col("depth") == depth).select(*columns)))
        levels.append(below)
    return levels


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the conversations' trie; `convs` has (conv_id, turns) as `own_turns` makes them.

    Per node: conv_id, its smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens, over its subtree the lengths
    that members beyond the first need not store again; ends_sha256, the hash of the ids of the conversations that end there.
    """
    seqs = settle(chained(convs))
    inside, above, deepest = blocks(settle(distinct_sequences(seqs)))
    nodes = settle(peel_blocks(inside))
    levels = peel_levels(nodes.filter("path IS NOT NULL"), above, deepest)
    names = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    out = nodes.filter("path IS NULL").select(*names)
    for level, parents in zip(levels, levels[1:]):
        with_parent = level.withColumn("parent", prefix_key(F.col("depth") - 1)).join(
            parents.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
        out = out.unionByName(with_parent.select(*names))
    return out.unionByName(levels[-1].withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*names))


ship(__name__)
