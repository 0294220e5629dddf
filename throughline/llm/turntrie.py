"""Prefix trie of conversations by adaptive radix trees over turn ids.

A turn's id has WIDTH bytes: the length of its text, big-endian, and a digest of role and text. A
conversation's key is the concatenation of its turns' ids, so the nodes of the trie are the byte
depths of a radix tree that are multiples of WIDTH, and a key's order is that of its ids.

Keys are dealt out by range and equal keys reach one task as chunks of joined conversation ids, so
a conversation that very many repeat is a few rows. Each task builds one adaptive radix tree of its
distinct keys: inner nodes of 4, 16, 48 or 256 places, single paths compressed into a node's
prefix. A node of the trie that lies inside one range is complete in its task. Only nodes on the
path to a range's first or last key may go on in a neighbouring range; they leave the task as
parts, and what two neighbouring ranges have counted twice is found from the keys that meet at
their border and taken off when the parts are added up.

Limits: a conversation's key is one binary value (2 GB, or 100 million turns).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from throughline.llm.frames import ship, stage
from throughline.session import small_side

#: Bytes of a text's length, and of a turn's id.
HEAD, WIDTH = 4, 20
#: Ids of conversations that may stand together in one chunk of an equal key.
CHUNK = 4096
#: Bytes of keys that a task's tree is meant to hold, and rows of its result that it hands over at once.
TREE, BATCH = 4 << 20, 8192
#: Turns that a rebuilt conversation may take from another one are fewer than this.
HEADS = 9


class Few:
    """Places for up to `size` children in the order of their bytes."""

    __slots__ = ("size", "keys", "kids")

    def __init__(self, size: int, keys=(), kids=()):
        self.size, self.keys, self.kids = size, bytearray(keys), list(kids)

    def find(self, byte: int):
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def add(self, byte: int, kid):
        """The layout that holds the new child, too: this one, or the next larger one."""
        if len(self.keys) == self.size:
            return (Few(16, self.keys, self.kids) if self.size == 4 else Indexed(self.keys, self.kids)).add(byte, kid)
        at = bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def __iter__(self):
        return iter(self.kids)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "kids")

    def __init__(self, keys, kids):
        self.index, self.kids = bytearray(256), list(kids)
        for at, byte in enumerate(keys):
            self.index[byte] = at + 1

    def find(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def add(self, byte: int, kid):
        if len(self.kids) == 48:
            return Direct((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at).add(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def __iter__(self):
        return (self.kids[at - 1] for at in self.index if at)


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("kids",)

    def __init__(self, found):
        self.kids = [None] * 256
        for byte, kid in found:
            self.kids[byte] = kid

    def find(self, byte: int):
        return self.kids[byte]

    def add(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def __iter__(self):
        return (kid for kid in self.kids if kid is not None)


class Node:
    """A node of the radix tree: the bytes of its single path, what ends here, and its children by the next byte.

    `seen` is what the subtree adds up to: members, least member, childless nodes, saved bytes,
    nodes at the next aligned depth, least and greatest key. `made` are the trie's nodes on its path.
    """

    __slots__ = ("prefix", "value", "kids", "start", "seen", "made")

    def __init__(self, prefix: bytes, value=None, kids=None):
        self.prefix, self.value, self.kids = prefix, value, Few(4) if kids is None else kids

    def insert(self, key: bytes, value) -> None:
        node, at = self, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = next((i for i, (a, b) in enumerate(zip(prefix, key[at:at + len(prefix)])) if a != b), len(key) - at)
                lower = Node(prefix[same + 1:], node.value, node.kids)
                node.prefix, node.value, node.kids = prefix[:same], None, Few(4).add(prefix[same], lower)
                prefix = node.prefix
            at += len(prefix)
            if at == len(key):
                node.value = (key, *value)
                return
            kid = node.kids.find(key[at])
            if kid is None:
                node.kids = node.kids.add(key[at], Node(key[at + 1:], (key, *value)))
                return
            node, at = kid, at + 1

    def below(self) -> Iterator[Node]:
        """All nodes with the byte depth before each one's edge set, parents first."""
        self.start = 0
        stack = [(self, True)]
        while stack:
            node, top = stack.pop()
            yield node
            end = node.start + (0 if top else 1) + len(node.prefix)
            for kid in node.kids:
                kid.start = end
                stack.append((kid, False))


def turn_bytes(key: bytes, depth: int) -> int:
    """The bytes of the text of the turn with this number, from 1."""
    return int.from_bytes(key[(depth - 1) * WIDTH:(depth - 1) * WIDTH + HEAD], "big")


def prefix_ids(key: bytes) -> list[bytes]:
    """The name of each prefix of whole turns, the empty one first."""
    h = hashlib.sha256()
    out = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at:at + WIDTH])
        out.append(h.copy().digest())
    return out


def add_up(root: Node) -> list[Node]:
    """Fill in `seen` and `made` from the ends of the tree; its nodes, parents first.

    An entry of `made`: depth, children, childless nodes below or here, saved bytes, digest of the members that end here.
    """
    nodes = list(root.below())
    for node in reversed(nodes):
        key, n, least, ends = node.value or (None, 0, None, None)
        leaves = saved = tops = 0
        low = high = key
        for kid in node.kids:
            k_n, k_least, k_leaves, k_saved, k_tops, k_low, k_high = kid.seen
            n, leaves, saved, tops = n + k_n, leaves + k_leaves, saved + k_saved, tops + k_tops
            least = k_least if least is None else min(least, k_least)
            low = k_low if low is None else low
            high = k_high
        stop = node.start + len(node.prefix) + (node is not root)
        node.made = []
        for depth in range(stop // WIDTH, node.start // WIDTH, -1):
            leaves = leaves or 1
            saved += (n - 1) * turn_bytes(low, depth)
            node.made.append((depth, tops, leaves, saved, ends if depth * WIDTH == stop else None))
            tops = 1
        if node is root:
            leaves = leaves or 1
            node.made.append((0, tops, leaves, saved, ends if stop == 0 else None))
        node.seen = (n, least, leaves, saved, tops, low, high)
    return nodes


NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends string, node binary, parent binary, first binary, last binary")
KINDS = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * 4
NAMES = [c.split()[0] for c in NODES.split(", ")]


def rows_of(root: Node, first: bytes, last: bytes) -> Iterator[tuple]:
    """The trie's nodes, and at the end a row with the first and the last key.

    Nodes on the path to one of these two keys carry their name in `node`, children of such nodes
    the name of their parent in `parent`.
    """
    nodes = add_up(root)
    names_first, names_last = prefix_ids(first), prefix_ids(last)
    above: dict[int, tuple] = {id(root): (None, None)}
    for node in nodes:
        n, least, *_, low, high = node.seen
        parent, parent_name = above.pop(id(node))
        names = names_first if low == first else names_last if high == last else None
        for depth, children, leaves, saved, ends in reversed(node.made):
            name = names[depth] if names else None
            yield (depth, least, parent, n, children, leaves, saved, ends, name, parent_name, None, None)
            parent, parent_name = least, name
        for kid in node.kids:
            above[id(kid)] = (parent, parent_name)
    yield (-1, *[None] * 9, first, last)


def turn_ids(df: DataFrame, role: str = "role", text: str = "text", out: str = "turn_id") -> DataFrame:
    """`df` with the id of each turn: its text's length in bytes, then a digest of role and text. Null counts as empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)
    return df.withColumn(out, F.unhex(F.concat(F.lpad(F.hex(F.octet_length(t)), 2 * HEAD, "0"), F.substring(digest, 1, 2 * (WIDTH - HEAD)))))


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key) of each conversation c, rebuilt: the first h turns of conversation c - c % 5, then its own from turn h on.

    h is crc32 of the id's decimal text modulo 9. Turns are ordered by `turn`, null first; turns of the same
    number by their ids. Null role or text counts as empty; rows without a conversation id belong to none.
    The five conversations of a base are next to each other in one sorted task, which keeps eight turns of the base.
    """
    ship(conversations.sparkSession)
    base = F.col("conv_id") - F.col("conv_id") % 5
    rows = (turn_ids(conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                                          F.col(role).alias("role"), F.col(text).alias("text"))
                     .filter("conv_id is not null"))
            .select("conv_id", "turn", "turn_id", base.alias("base"),
                    (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("head")))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "turn_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = own = None
        common, common_of, done = b"", None, []

        def close() -> None:
            nonlocal common, common_of
            c, b, h = now
            key = b"".join(own)
            if c == b:
                common, common_of = key[:HEADS * WIDTH], b
            done.append((c, (common[:h * WIDTH] if common_of == b else b"") + key[h * WIDTH:]))

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([k for _, k in done], pa.binary())],
                                             names=["conv_id", "key"])
            done.clear()
            return out

        for batch in batches:
            for c, b, h, i in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "base", "head", "turn_id")), strict=True):
                if now is None or now[0] != c:
                    if now:
                        close()
                    now, own = (c, b, h), []
                own.append(i)
            yield table()
        if now:
            close()
            yield table()

    return rows.mapInArrow(run, "conv_id long, key binary")


def plain(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key) of each conversation as it is; the order of turns is that of `rebuilt`."""
    ship(conversations.sparkSession)
    rows = (turn_ids(conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                                          F.col(role).alias("role"), F.col(text).alias("text")).filter("conv_id is not null"))
            .select("conv_id", "turn", "turn_id").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "turn_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            done = []
            for c, i in zip(batch.column("conv_id").to_pylist(), batch.column("turn_id").to_pylist(), strict=True):
                if c != now and own:
                    done.append((now, b"".join(own)))
                    own = []
                now = c
                own.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([k for _, k in done], pa.binary())],
                                             names=["conv_id", "key"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(own)], pa.binary())], names=["conv_id", "key"])

    return rows.mapInArrow(run, "conv_id long, key binary")


def chunks(keys: DataFrame) -> DataFrame:
    """Equal keys together: (key, n, least, members), at most CHUNK neighbouring conversation ids in a row, joined by commas."""
    return (keys.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("_chunk"))
            .agg(F.count("*").alias("n"), F.min("conv_id").alias("least"),
                 F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("members"))
            .drop("_chunk"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's tree of sorted chunks, handed over as rows of the trie."""
    root, key, first = Node(b""), None, None
    n = least = digest = None

    def close() -> None:
        root.insert(key, (n, least, digest.hexdigest()))

    for batch in batches:
        for k, count, low, members in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "members")), strict=True):
            if k != key:
                if key is not None:
                    close()
                key, n, least, digest = k, 0, low, hashlib.sha256()
                first = k if first is None else first
            digest.update((f",{members}" if n else members).encode())
            n, least = n + count, min(least, low)
    if key is None:
        return
    close()
    done: list[tuple] = []

    def table() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(KINDS)], names=NAMES)
        done.clear()
        return out

    for row in rows_of(root, first, key):
        done.append(row)
        if len(done) == BATCH:
            yield table()
    yield table()


SHARED = "node binary, n_children long, n_leaves long, saved_tokens long"


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges have counted twice at each node that both hold, as amounts to add."""
    for batch in batches:
        for a, b in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist(), strict=True):
            depth = 0
            while a[depth * WIDTH:(depth + 1) * WIDTH] == b[depth * WIDTH:(depth + 1) * WIDTH] != b"":
                depth += 1
            names, saved, rows = prefix_ids(a[:depth * WIDTH]), 0, []
            childless = len(a) == depth * WIDTH  # the last key goes on in the next range, so it was no childless node
            for d in range(depth, -1, -1):
                saved += turn_bytes(a, d) if d else 0
                rows.append((names[d], -1 if d < depth else 0, -1 if childless else 0, saved))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.binary()] + [pa.int64()] * 3)],
                                             names=["node", "n_children", "n_leaves", "saved_tokens"])


def trie(keys: DataFrame, tree_bytes: int = TREE) -> DataFrame:
    """The nodes of the trie of (conv_id, key): conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A conversation id is expected once. An empty table has no nodes, not even a root. `tree_bytes`
    bounds the keys that a task's tree is meant to hold; it changes nothing in the result.
    """
    ship(keys.sparkSession)
    parts = stage(chunks(keys), "turn-keys")
    size = parts.agg(F.coalesce(F.sum(F.length("key") + 64), F.lit(0)).alias("b")).first().b
    trees = stage(parts.repartitionByRange(1 + size // tree_bytes, "key").sortWithinPartitions("key", "least").mapInArrow(_trees, NODES), "turn-tries")

    border = Window.orderBy("first")  # one row of each range
    meet = trees.filter("depth = -1").select("last", F.lead("first").over(border).alias("next")).filter("next is not null")
    twice = meet.mapInArrow(_twice, SHARED)
    nodes = trees.filter("depth >= 0").drop("first", "last")
    parts_of = nodes.filter("node is not null")
    summed = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = stage(
        parts_of.unionByName(twice, allowMissingColumns=True).groupBy("node")
        .agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in summed],
             F.max("ends").alias("ends"), F.max("parent").alias("parent")), "turn-shared")
    names = small_side(shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_least")))
    columns = ["conv_id", "depth", "parent_conv_id", *summed, "ends"]
    under = (nodes.filter("node is null and parent is not null").drop("parent_conv_id", "node")
             .unionByName(shared.drop("node"))
             .join(names, "parent", "left").withColumn("parent_conv_id", F.col("_least")))
    out = nodes.filter("node is null and parent is null").select(*columns).unionByName(under.select(*columns))
    return out.select(*columns[:-1], F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
