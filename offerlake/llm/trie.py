"""Operator 13: the prefix trie of conversations, by adaptive radix trees.

A turn becomes a fixed-width id, the first 16 bytes of a SHA-256 over role and text, read
big-endian; a conversation is the byte string of its ids. Tasks put the conversations of
their partition into adaptive radix trees (nodes of 4, 16, 48 or 256 children that grow into
each other, with path compression) and walk them in byte order. A tree's nodes may branch at any byte;
only depths at whole turns emit a trie node, named by a digest of its whole prefix. Spark
merges what the tasks emit by that digest, so a prefix that a third of all conversations
share is a row per task before it is shuffled.

Two passes suffice for sums over subtrees. Each node is owned by its smallest member; along a
conversation the nodes that it owns are the deeper ones, from its *own depth* on. The first pass gives
members, smallest member and longest member of every node, and with them every conversation's
own depth. Sums over the distinct nodes of a subtree are then sums over its
conversations, each counting the nodes that it owns, and the second pass adds them up.
Texts leave the data after the ids are made; what a task holds of a conversation is 20 bytes a turn.

Defined results
    Turns go by number, null first, then by role and text; null role or text counts as
    empty. Repeated rows are turns of their own. Rows without a conversation id take no
    part. A conversation that loses all its turns is a member of the root only. An empty
    table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import written

#: Bytes of a turn id, and turns that a task puts into one tree at most (or one conversation).
WIDTH, TREE_TURNS = 16, 200_000
#: Ends of a node that are joined into one string by a task.
END_ROWS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class Small:
    """Up to 4 or 16 children: sorted key bytes beside the children."""

    __slots__ = ("path", "ends", "keys", "kids", "room")

    def __init__(self, path: bytes, room: int = 4):
        self.path, self.ends, self.keys, self.kids, self.room = path, None, bytearray(), [], room

    def get(self, key: int):
        at = bisect_left(self.keys, key)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == key else None

    def put(self, key: int, kid):
        """Add or replace a child; returns the node that now holds it, a larger layout if this one is full."""
        at = bisect_left(self.keys, key)
        if at < len(self.keys) and self.keys[at] == key:
            self.kids[at] = kid
        elif len(self.keys) < self.room:
            self.keys.insert(at, key)
            self.kids.insert(at, kid)
        else:
            larger = Small(self.path, 16) if self.room == 4 else Indexed(self.path)
            larger.ends = self.ends
            for k, child in zip(self.keys, self.kids, strict=True):
                larger.put(k, child)
            return larger.put(key, kid)
        return self

    def children(self):
        return self.kids


class Indexed:
    """Up to 48 children: an index byte for each of the 256 key bytes."""

    __slots__ = ("path", "ends", "index", "kids")

    def __init__(self, path: bytes):
        self.path, self.ends, self.index, self.kids = path, None, bytearray(256), []

    def get(self, key: int):
        at = self.index[key]
        return self.kids[at - 1] if at else None

    def put(self, key: int, kid):
        at = self.index[key]
        if at:
            self.kids[at - 1] = kid
        elif len(self.kids) < 48:
            self.kids.append(kid)
            self.index[key] = len(self.kids)
        else:
            larger = Full(self.path)
            larger.ends = self.ends
            for k, at in enumerate(self.index):
                if at:
                    larger.kids[k] = self.kids[at - 1]
            return larger.put(key, kid)
        return self

    def children(self):
        return [self.kids[at - 1] for at in self.index if at]


class Full:
    """256 children, one place for each key byte."""

    __slots__ = ("path", "ends", "kids")

    def __init__(self, path: bytes):
        self.path, self.ends, self.kids = path, None, [None] * 256

    def get(self, key: int):
        return self.kids[key]

    def put(self, key: int, kid):
        self.kids[key] = kid
        return self

    def children(self):
        return [kid for kid in self.kids if kid is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] agrees, the first difference is at most at high
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTree:
    """Adaptive radix tree from byte strings to the numbers put under them."""

    def __init__(self):
        self.root = Small(b"")

    def insert(self, key: bytes, number: int) -> None:
        parent, edge, node, at = None, 0, self.root, 0
        while True:
            agreed = _common(node.path, key[at:at + len(node.path)])
            if agreed < len(node.path):  # split the compressed path
                upper = Small(node.path[:agreed])
                below, node.path = node.path[agreed], node.path[agreed + 1:]
                upper.put(below, node)
                if parent is None:
                    self.root = upper
                else:
                    parent.put(edge, upper)
                node = upper
            at += agreed
            if at == len(key):
                if node.ends is None:
                    node.ends = []
                node.ends.append(number)
                return
            kid = node.get(key[at])
            if kid is None:
                leaf = Small(key[at + 1:])
                leaf.ends = [number]
                grown = node.put(key[at], leaf)
                if grown is not node:
                    if parent is None:
                        self.root = grown
                    else:
                        parent.put(edge, grown)
                return
            parent, edge, node, at = node, key[at], kid, at + 1

    def walk(self) -> tuple[list[int], list[tuple[int, int, int, int]]]:
        """Numbers in byte order of their strings, shorter first, and for every node of the tree
        (byte depth above its path and edge, byte depth below, first and last + 1 place of its numbers)."""
        order: list[int] = []
        spans: list[list[int]] = []
        stack: list[tuple] = [(self.root, 0, None)]
        while stack:
            node, depth, opened = stack.pop()
            if opened is not None:
                spans[opened][3] = len(order)
                continue
            below = depth + len(node.path) + (1 if node is not self.root else 0)
            spans.append([depth, below, len(order), 0])
            stack.append((node, depth, len(spans) - 1))
            if node.ends:
                order.extend(node.ends)
            stack.extend((kid, below, None) for kid in reversed(node.children()))
        return order, [tuple(s) for s in spans]


def turn_nodes(keys: list[bytes], width: int = WIDTH) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Numbers of the keys in byte order, and the nodes at whole turns: (depth in turns, first, last + 1 place), top down."""
    tree = RadixTree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    order, spans = tree.walk()
    nodes = [(0, 0, len(keys))] if keys else []
    for above, below, low, high in spans:
        nodes += [(d, low, high) for d in range(above // width + 1, below // width + 1)]
    return order, nodes


def _trees(batches: Iterator[pa.RecordBatch], emit, columns: int) -> Iterator[pa.RecordBatch]:
    """Runs ``emit(keys, chars, rest)`` on bounded lots of conversations: columns ids, chars and ``columns`` more."""
    keys, chars, rest, held = [], [], [[] for _ in range(columns)], 0
    for batch in batches:
        ids, lengths = batch.column(0), batch.column(1)
        more = [batch.column(2 + c).to_pylist() for c in range(columns)]
        for i in range(batch.num_rows):
            own = ids[i].values
            n = 0 if own is None else len(own)
            if held + n > TREE_TURNS and keys:
                yield emit(keys, chars, rest)
                keys, chars, rest, held = [], [], [[] for _ in range(columns)], 0
            keys.append(b"".join(own.to_pylist()) if n else b"")
            chars.append(lengths[i].values.to_numpy() if n else np.zeros(0, np.int64))
            for r, m in zip(rest, more, strict=True):
                r.append(m[i])
            held += n
    if keys:
        yield emit(keys, chars, rest)


def _names(keys: list[bytes], order: list[int], nodes: list[tuple[int, int, int]]) -> list[bytes]:
    """Digest of the whole prefix of every node; the root's is of nothing."""
    at: dict[int, bytes] = {}
    out = []
    for depth, low, _ in nodes:  # top down: the name one turn above was the last made at that depth
        if depth == 0:
            name = hashlib.blake2b(b"", digest_size=WIDTH).digest()
        else:
            own = keys[order[low]]
            name = hashlib.blake2b(at[depth - 1] + own[(depth - 1) * WIDTH:depth * WIDTH], digest_size=WIDTH).digest()
        at[depth] = name
        out.append(name)
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: members, smallest and longest member of the nodes, and the text length of their last turn."""

    def emit(keys, chars, rest):
        order, nodes = turn_nodes(keys)
        names = _names(keys, order, nodes)
        conv = np.array(rest[0], np.int64)[order]
        turns = np.array([len(keys[i]) // WIDTH for i in order])
        low, high = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])
        single = high - low == 1
        least, longest = conv[low], turns[low]
        for k in np.flatnonzero(~single):
            least[k], longest[k] = conv[low[k]:high[k]].min(), turns[low[k]:high[k]].max()
        parents, above = [], {}
        for (depth, _, _), name in zip(nodes, names, strict=True):
            above[depth] = name
            parents.append(above[depth - 1] if depth else None)
        last = [0 if depth == 0 else int(chars[order[a]][depth - 1]) for depth, a, _ in nodes]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(parents, pa.binary()), pa.array([n[0] for n in nodes], pa.int64()),
             pa.array(high - low), pa.array(least), pa.array(longest, pa.int64()), pa.array(last, pa.int64())],
            names=["node", "parent", "depth", "n_convs", "conv_id", "longest", "chars"])

    yield from _trees(batches, emit, 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: children, leaves and saved characters that the conversations bring to each node, and where they end."""

    def emit(keys, chars, rest):
        order, nodes = turn_nodes(keys)
        names = _names(keys, order, nodes)
        conv, own, leaf = (np.array(rest[c], np.int64)[order] for c in range(3))
        turns = np.array([len(keys[i]) // WIDTH for i in order])
        before = [np.concatenate([[0], np.cumsum(chars[i])]) for i in order]  # characters of the first d turns
        unowned = np.array([int(b[min(max(o - 1, 0), len(b) - 1)]) for b, o in zip(before, own.tolist(), strict=True)])
        depth, low, high = (np.array([n[c] for n in nodes]) for c in range(3))
        # a node of one member, the first of its span, in one go; the others follow one by one
        here = np.array([int(before[a][max(d - 1, 0)]) for d, a, _ in nodes])
        children = ((turns[low] > depth) & (own[low] <= depth + 1)).astype(np.int64)
        leaves, saved = leaf[low], np.where(own[low] > depth, unowned[low] - here, 0)
        ends = turns[low] == depth
        end_at, end_conv = np.flatnonzero(ends & (high - low == 1)).tolist(), conv[low[ends & (high - low == 1)]].tolist()
        for k in np.flatnonzero(high - low > 1).tolist():
            d, span = depth[k], slice(low[k], high[k])
            o, t = own[span], turns[span]
            children[k], leaves[k] = ((t > d) & (o <= d + 1)).sum(), leaf[span].sum()
            saved[k] = unowned[span][o > d].sum() - here[k] * (o > d).sum()
            here_ends = conv[span][t == d].tolist()
            end_at += [k] * len(here_ends)
            end_conv += here_ends
        kinds = [0] * len(nodes) + [1] * len(end_at)
        at = list(range(len(nodes))) + end_at
        pad = np.zeros(len(end_at), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in at], pa.binary()), pa.array(kinds, pa.int32()), pa.array(np.r_[children, pad]),
             pa.array(np.r_[leaves, pad]), pa.array(np.r_[saved, pad]),
             pa.array([None] * len(nodes) + end_conv, pa.int64())], names=["node", "kind", "n_children", "n_leaves", "saved_tokens", "conv"])

    yield from _trees(batches, emit, 3)


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            family: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): every conversation's turn ids and text lengths, its first h turns taken from the first
    conversation of its ``family``; h is crc32 of the decimal id modulo ``most``."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # only turns that share a number need role and text to be put in order
    ties = written(rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.lit(True).alias("_tied")), "trie")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    identity = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH))
    slim = rows.join(ties, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").select(
        "conv_id", F.struct("turn", F.when(F.col("_tied"), F.col("role")).alias("role"), F.when(F.col("_tied"), F.col("text")).alias("text"),
                            identity.alias("id"), F.length("text").cast("long").alias("chars")).alias("turn"))
    ordered = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    own = written(slim.groupBy("conv_id").agg(ordered.alias("turns")), "trie")
    first = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, most - 1).alias("_shared"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.expr("cast(array() as array<struct<id: binary, chars: bigint>>)")
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("_first"), "left")
    joined = F.concat(F.when(taken > 0, F.slice(F.coalesce("_shared", none), F.lit(1), F.greatest(taken, F.lit(1)))).otherwise(none),
                      F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", joined.alias("turns"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, cell, part) in order: SHA-256 of the parts of a node, with commas between them."""
    current, digest = None, None
    for batch in batches:
        names, out = [], []
        for node, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != current:
                if current is not None:
                    names.append(current)
                    out.append(digest.hexdigest())
                current, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], names=["end", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of ``conversations`` (conv_id, turns: array of id and chars, each conv_id once): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = conversations.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))
    rows = written(rows, "trie")
    made = rows.select("ids", "chars", "conv_id").mapInArrow(
        _members, "node binary, parent binary, depth long, n_convs long, conv_id long, longest long, chars long")
    nodes = written(made.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.max("longest").alias("longest")), "trie")
    owners = nodes.groupBy(F.col("conv_id").alias("_owner")).agg(
        F.min("depth").alias("own"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"))
    owned = rows.join(owners, F.col("conv_id") == F.col("_owner"), "left").select(
        "ids", "chars", "conv_id", F.coalesce("own", F.size("ids") + 1).cast("long").alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    parts = written(owned.mapInArrow(_sums, "node binary, kind int, n_children long, n_leaves long, saved_tokens long, conv long"), "trie")
    sums = parts.where("kind = 0").groupBy(F.col("node").alias("_node")).agg(
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    # ids of a cell are in a row and at most END_ROWS of them, as each is there once
    cells = parts.where("kind = 1").groupBy("node", F.expr(f"conv div {END_ROWS} - if(conv % {END_ROWS} < 0, 1, 0)").alias("cell")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("part"))
    ends = cells.repartition("node").sortWithinPartitions("node", "cell").mapInArrow(_digests, "end binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, F.col("parent") == F.col("_above"), "left")
    return named.join(sums, F.col("node") == F.col("_node")).join(ends, F.col("node") == F.col("end"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def oracle() -> str:
    step = "xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    bits = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"""
    WITH own AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                             ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    hashed AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, x: {step}), 4294967295) % 6 AS h FROM own),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
        FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
    prefixes AS (
        SELECT conv_id, depth, size, turns[1:depth] AS prefix
        FROM (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, len(turns) AS size, turns FROM rebuilt)),
    nodes AS (
        SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
        FROM prefixes GROUP BY prefix, depth),
    above AS (SELECT *, size = depth AS leaf, unnest(range(0, depth + 1)) AS up FROM nodes),
    sums AS (
        SELECT top AS prefix, up AS depth, sum(leaf::INT)::BIGINT AS n_leaves, sum((depth = up + 1)::INT)::BIGINT AS n_children,
               sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END)::BIGINT AS saved_tokens
        FROM (SELECT *, prefix[1:up] AS top FROM above) a GROUP BY top, up)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
    LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""
