"""Prefix trie over conversations: which turns are shared, and what sharing saves.

Turns (role, text) are numbered by a dictionary of the distinct ones, so everything after it works on
ids.  Conversations of one sequence are collapsed to that sequence with its number of members and least
member; the sequences are dealt into shards by ranges of their id arrays, so a shard holds neighbours of the sorted
order.  A shard builds a ternary search tree (a node splits on one turn id: less, equal, greater), inserting its
sorted sequences median first, which balances it; an iterative walk then adds up members, leaves and
savings from the deepest nodes to the root.

Only prefixes on the path that a shard's first sequence shares with the shard before, or its last one with the shard
after, can occur in several shards.  Which of them are new in a shard, and whether a sequence goes on in the next shard, is read from
the shards' first and last sequences; so each shard's part of such a boundary node adds up without counting
anything twice, and the parts are merged by the hash of the prefix.

Defined results: rows without a conversation id take no part; null role or text is empty; turns are ordered with null first, equal turn numbers
by role and SHA-256 of role and text; repeated rows are turns of their own; an empty table gives no rows; other columns play no part.
The ids of one conversation (8 bytes a turn and 4 for its length) must fit in one row; texts are dropped after the dictionary.  The
conversations of one sequence, however many, meet only as strings of at most ``BLOCK`` ids, hashed in a stream.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.llm.common import sha256_hex
from curata.session import checkpointed

SHARD_TURNS = 50_000    # turns of distinct sequences that a shard holds on average
BLOCK = 4096            # conversation ids in one string of a member list
ROOT = ""               # the hash of the empty prefix

PART = ("key string, parent_key string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "end_key string, shared boolean, parent_shared boolean, parent_conv_id long")


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): the dictionary ids of a conversation's turns in order, and the bytes of their texts."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"),
        sha256_hex(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("sha"), F.octet_length(t).alias("size"))
    turns = checkpointed(turns, "turns")
    known = checkpointed(turns.groupBy("sha").agg(F.first("size").alias("size")).withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    named = turns.drop("size").join(known, "sha")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "sha", "id", "size")))
    return named.groupBy("conv_id").agg(ordered.alias("x")).select("conv_id", F.col("x.id").alias("ids"), F.col("x.size").alias("sizes"))


def regrafted(numbered: DataFrame, base: Column, taken: Column) -> DataFrame:
    """(conv_id, ids, sizes) with the first ``taken`` turns of conversation ``base`` before a conversation's own turns
    after its first ``taken``; a base that isn't there gives none."""
    own = numbered.select("conv_id", base.alias("base"), taken.cast("int").alias("h"), "ids", "sizes")
    other = numbered.select(F.col("conv_id").alias("base"), F.col("ids").alias("base_ids"), F.col("sizes").alias("base_sizes"))
    joined = own.join(other, "base", "left")
    grown = lambda c, kind: F.concat(F.coalesce(F.slice(f"base_{c}", 1, F.col("h")), F.array().cast(kind)),
                                     F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)
    return joined.select("conv_id", grown("ids", "array<long>"), grown("sizes", "array<int>"))


def shared_start(a: Column, b: Column) -> Column:
    """How many leading items two arrays share; null where one is null."""
    unequal = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), 0)      # 1-based, 0: none
    length = F.when(unequal > 0, unequal - 1).otherwise(F.least(F.size(a), F.size(b)))
    return F.when(a.isNotNull() & b.isNotNull(), length).cast("int")


class Tree:
    """Ternary search tree over arrays of turn ids.

    Node 0 is the root of the trie (no turn); of the others ``split`` is the turn id, ``low``/``high`` the
    siblings with smaller/greater ids, ``equal`` the top of the children's search tree.
    """

    def __init__(self):
        self.split, self.low, self.high, self.equal = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.size = [-1], [0], [0]
        self.members, self.least, self.end = [0], [None], [None]

    def _node(self, split: int, size: int, parent: int) -> int:
        for column, value in ((self.split, split), (self.low, -1), (self.high, -1), (self.equal, -1), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.size, size), (self.members, 0), (self.least, None), (self.end, None)):
            column.append(value)
        return len(self.split) - 1

    def insert(self, ids, sizes, members: int, least: int, end) -> None:
        at = 0
        self._count(0, members, least)
        for turn, size in zip(ids, sizes):
            child, link, holder = self.equal[at], self.equal, at
            while child >= 0 and self.split[child] != turn:
                holder, link = child, self.low if turn < self.split[child] else self.high
                child = link[holder]
            if child < 0:
                child = self._node(turn, size, at)
                link[holder] = child
            at = child
            self._count(at, members, least)
        self.end[at] = end

    def _count(self, node: int, members: int, least: int) -> None:
        self.members[node] += members
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def child(self, node: int, turn: int) -> int:
        """The child of a node by a turn that it has."""
        at = self.equal[node]
        while self.split[at] != turn:
            at = self.low[at] if turn < self.split[at] else self.high[at]
        return at

    def by_depth(self) -> list[int]:
        """Nodes from the root down, by an iterative walk of the search trees."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            child = [self.equal[node]]
            while child:
                c = child.pop()
                if c >= 0:
                    stack.append(c)
                    child += (self.low[c], self.high[c])
        return order


def median_first(n: int) -> Iterator[int]:
    """0..n-1 in the order of median insertion."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += ((mid + 1, hi), (lo, mid))


def prefix_key(key: str, turn: int) -> str:
    return hashlib.blake2b(f"{key},{turn}".encode(), digest_size=16).hexdigest()


def shard_nodes(rows: pd.DataFrame, before: int, after: int, goes_on: bool) -> pd.DataFrame:
    """The nodes of one shard (``PART``).

    ``rows``: ids, sizes, members, least, end_key, of distinct sequences.  The first sequence shares ``before`` turns with the shard
    before (-1: there is none), the last one ``after`` turns with the shard after; ``goes_on``: the shard after starts with the whole last sequence.
    Nodes up to these depths on the two paths are shared: their numbers are this shard's part, a node or child that the shard before
    has is not counted again.
    """
    sequences = sorted(zip((x.tolist() for x in rows.ids), (x.tolist() for x in rows.sizes), rows.members.tolist(), rows.least.tolist(), rows.end_key))
    tree = Tree()
    for k in median_first(len(sequences)):
        tree.insert(*sequences[k])
    first, final, n = sequences[0][0], sequences[-1][0], len(tree.split)
    order = tree.by_depth()
    shared, known = [False] * n, [False] * n

    def mark(ids, depth: int, also_known: bool) -> None:
        at = 0
        for k in range(depth + 1):
            shared[at] = True
            known[at] = known[at] or also_known
            if k < depth:
                at = tree.child(at, ids[k])

    mark(first, before, True)
    mark(final, after, False)
    children, leaves, saved, key = [0] * n, [0] * n, [0] * n, [ROOT] * n
    for node in order[1:]:
        up = tree.parent[node]
        if not known[node]:
            children[up] += 1
        if shared[up]:
            key[node] = prefix_key(key[up], tree.split[node])
    last = 0                                     # the node where the shard's last sequence ends
    for turn in final:
        last = tree.child(last, turn)
    for node in reversed(order):
        if tree.equal[node] < 0 and not (goes_on and node == last):
            leaves[node] += 1
        saved[node] += (tree.members[node] - (not known[node])) * tree.size[node]
        if node:
            leaves[tree.parent[node]] += leaves[node]
            saved[tree.parent[node]] += saved[node]
    up = tree.parent
    return pd.DataFrame({
        "key": [key[v] if shared[v] else None for v in order], "parent_key": [key[up[v]] if v and shared[up[v]] else None for v in order],
        "depth": [tree.depth[v] for v in order], "conv_id": [tree.least[v] for v in order], "n_convs": [tree.members[v] for v in order],
        "n_children": [children[v] for v in order], "n_leaves": [leaves[v] for v in order], "saved_tokens": [saved[v] for v in order],
        "end_key": [tree.end[v] for v in order], "shared": [shared[v] for v in order], "parent_shared": [v > 0 and shared[up[v]] for v in order],
        "parent_conv_id": pd.array([tree.least[up[v]] if v and not shared[up[v]] else None for v in order], "Int64")})


def member_digests(members: DataFrame) -> DataFrame:
    """(end_key, ends_sha256): the hash of a sequence's conversation ids, ascending, joined by commas.

    Ids meet in strings of at most ``BLOCK``, which one task per sequence hashes one after the other as they are read."""
    block = F.floor(F.col("conv_id") / BLOCK)
    strings = members.groupBy("end_key", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = end, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["end_key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["end_key", "ends_sha256"])

    dealt = strings.repartition("end_key").sortWithinPartitions("end_key", "block").select("end_key", "ids")
    return dealt.mapInArrow(digest, "end_key string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over (conv_id, ids, sizes): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    named = checkpointed(sequences.withColumn("end_key", sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ","))), "sequences")
    distinct = checkpointed(named.groupBy("end_key").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least")), "distinct-sequences")
    turns = distinct.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, math.ceil(turns / shard_turns))
    dealt = checkpointed(distinct.repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()), "shards")
    ends = dealt.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))      # one row per shard
    w = Window.orderBy("shard")
    ends = ends.select("shard", "first", "last", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    after = F.coalesce(shared_start(F.col("last"), F.col("after")), F.lit(-1))
    ends = ends.select("shard", F.coalesce(shared_start(F.col("before"), F.col("first")), F.lit(-1)).alias("before"), after.alias("after"),
                       (after == F.size("last")).alias("goes_on"))

    def nodes(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        return shard_nodes(rows, int(one["before"]), int(one["after"]), bool(one["goes_on"]))

    parts = checkpointed(dealt.join(ends, "shard").groupBy("shard").applyInPandas(nodes, PART), "trie-parts")
    own = parts.where(~F.col("shared"))
    totals = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.where("shared").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *totals, F.max("end_key").alias("end_key"))
    merged = checkpointed(merged, "trie-boundaries")
    numbers = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    hung = own.where("parent_shared").select("parent_key", *numbers).unionByName(merged.select("parent_key", *numbers)).join(above, "parent_key", "left")
    everything = (own.where("NOT parent_shared").select("parent_conv_id", *numbers)
                  .unionByName(hung.select(F.col("above").alias("parent_conv_id"), *numbers)))
    digests = member_digests(named.select("end_key", "conv_id"))
    ending = everything.where(F.col("end_key").isNotNull()).join(digests, "end_key").drop("end_key")
    passing = everything.where(F.col("end_key").isNull()).drop("end_key").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    return ending.unionByName(passing).select(*long("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "ends_sha256")
