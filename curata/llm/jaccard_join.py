"""N-gram Jaccard join: an exact metric-space join of the word shingle sets of all documents.

Jaccard distance is a metric, and two documents link when it is at most r.  Equal sets are one
node.  The join has three levels, each with pivots:

1. *Regions by indexed pivots.*  The prefix of a set are its first ``n - ceil(s * n) + l`` shingles in one
   global order (frequent ones last), ``l = 1 + n / 20``: linked sets share at least ``min(l, l')`` shingles
   of their prefixes.  The pivot of a shingle is the least node whose prefix holds it; a node's votes for
   a pivot are the shared shingles of its prefix with that pivot.  A node with too few votes in all
   has no partner.  The others join the regions of the pivots with most votes, until the votes left
   out are so few that linked nodes still must meet in a region (`spare`).  This finds near pivots without
   measuring the distance to all, which random texts (all at distance 1 from each other) would need.
2. *Large regions* are dealt into blocks.  A few pivots are drawn by hash; every block measures its
   distances to them.  Nodes within r of a pivot link to it (so a pivot's links are complete
   and it leaves).  A region whose nodes are all connected is done.  Otherwise each node goes to
   the Voronoi cell of its nearest pivot and to every cell whose pivot is at most 2r farther (by
   the triangle inequality a linked partner may be nearest to it); when these windows cover more than
   ``SPREAD`` times the region it stays whole and gets more pivots.  Cells join recursively.
3. *Small regions* are joined inside a task by the same recursion.

A region yields a forest over its links, never its pairs, and pairs that are connected already
are not compared: the components are exact, the forest is not the list of all links.  Components
come from alternating large-star and small-star steps over checkpointed tables.

Shingles and sets are identified by 64-bit hashes.  The frequent shingles (counted in stretches of all
documents, at most ``FREQUENT`` are told to the tasks) only set the order of prefixes: they
change how many candidates there are, never which links are found.

Defined results: words are parts between ASCII white space, A-Z lower-cased; a text of fewer words than a
shingle is one shingle of all its words; null, empty and wordless texts have an empty set, link
with nothing and are their own component; repeated rows are in one component; a null id
never is the component's id unless all its documents have none; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.session import checkpointed

FREQUENT = 1 << 17        # shingles told to the tasks as frequent
STRETCH = 4_000_000       # shingles counted at a time
MEMO = 200_000            # words that a task remembers
REGION = 2_000_000        # shingles of a region that one task joins
SPREAD = 1.5              # largest growth by windows at which cells replace a region
FEW = 100_000             # members that are told to all tasks
LEAF = 12                 # nodes compared without cells

_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(dict):
    """word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, memo: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * _P + w[j:len(w) - size + 1 + j]
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return np.unique(h ^ (h >> np.uint64(31)))


def node_of(h: np.ndarray) -> int:
    """64-bit identity of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


# ---- inside a task -------------------------------------------------------------------------

class Forest:
    """Union-find over the nodes of a region."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def shared_with(pivot: np.ndarray, flat: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many shingles of ``pivot`` each set has; sets are stretches of ``flat``."""
    mark[pivot] = 1
    out = np.add.reduceat(mark[flat], starts)
    mark[pivot] = 0
    return out


def join_region(sets: list[np.ndarray], percent: int) -> list[int]:
    """For every set the least position in its component (links of this region only)."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, local = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    own = [local[e - n:e] for e, n in zip(ends, sizes)]
    mark = np.zeros(len(values), np.int32)
    forest = Forest(len(sets))
    r = 1 - percent / 100
    todo = [list(range(len(sets)))]
    while todo:
        members = todo.pop()
        flat = np.concatenate([own[i] for i in members])
        n = sizes[members]
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        roots = [forest.root(i) for i in members]
        most = Counter(roots).most_common(1)[0][0]
        rest = [p for p, x in enumerate(roots) if x != most]
        if not rest:
            continue
        # pivots from outside the largest component, spread over the rest
        pivots = rest[::max(1, len(rest) // 8)][:8] if len(members) > LEAF else rest
        distance = np.empty((len(pivots), len(members)))
        for row, p in enumerate(pivots):
            inter = shared_with(own[members[p]], flat, starts, mark)
            distance[row] = 1 - inter / (n + n[p] - inter)
            for q in np.flatnonzero(linked(inter, n, n[p], percent)):
                forest.join(members[p], members[q])
        if len(members) <= LEAF:
            continue
        done = set(pivots)
        cells = distance <= distance.min(axis=0) + 2 * r + 1e-9
        if cells.sum() <= SPREAD * len(members):
            parts = [[members[q] for q in np.flatnonzero(c) if q not in done] for c in cells]
        else:
            parts = [[members[q] for q in range(len(members)) if q not in done]]
        todo += [p for p in parts if len(p) > 1]
    return [forest.root(i) for i in range(len(sets))]


def _regions(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(region, nodes, sets) from rows (region, node, text) that are sorted by region."""
    memo, region, sets = Words(), None, {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for own, node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                if own != region:
                    if len(sets) > 1:
                        yield region, list(sets), list(sets.values())
                    region, sets = own, {}
                if node not in sets and node_of(h := shingle_set(text, words, memo)) == node:
                    sets[node] = h
    if len(sets) > 1:
        yield region, list(sets), list(sets.values())


# ---- level 1: prefixes and regions -----------------------------------------------------------

def frequent_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles that occur most often among different sets, rarest first (counted over all texts)."""

    def count(batches):
        memo, seen, parts, n = Words(), set(), [], 0

        def told():
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= 4].view(np.int64)), pa.array(c[c >= 4].astype(np.int64))], ["s", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.slice(at, 256).column(0).to_pylist():
                    h = shingle_set(t, words, memo)
                    if len(h) and (node := node_of(h)) not in seen:
                        seen.add(node)
                        parts.append(h)
                        n += len(h)
                if n >= STRETCH:
                    yield told()
                    seen, parts, n = set(), [], 0
        if parts:
            yield told()

    counted = texts.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()      # at most FREQUENT rows
    return top["s"].to_numpy(np.int64, copy=True)[::-1].copy().view(np.uint64)


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, node, n, prefix) of rows (id, text); node is null for an empty set."""
    frequent = frequent_shingles(docs.select("text"), words)
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))
    id_type = docs.schema["id"].dataType.simpleString()

    def first(h: np.ndarray, often: np.ndarray, place: np.ndarray) -> np.ndarray:
        least = min(len(h), len(h) - -(-percent * len(h) // 100) + 1 + len(h) // 20)
        at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
        known = often[at] == h if len(often) else np.zeros(len(h), bool)
        rare = h[~known][:least]
        return rare if len(rare) == least else np.concatenate([rare, h[known][np.argsort(place[at[known]], kind="stable")][:least - len(rare)]])

    def cut(batches):
        memo, (often, place) = Words(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, words, memo) for t in part.column(1).to_pylist()]
                heads = [first(h, often, place).view(np.int64) if len(h) else np.zeros(0, np.int64) for h in sets]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([node_of(h) if len(h) else None for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))], ["id", "node", "n", "prefix"])

    return checkpointed(docs.mapInArrow(cut, f"id {id_type}, node long, n int, prefix array<long>"), "prefixes")


def spare(n: Column, percent: int) -> Column:
    """Votes that a node of n shingles may leave out.

    With ``p = percent / 100`` linked sizes differ by a factor of at most 1 / p, so l < 1 + l' / p for l' <= l; both
    together leave out at most ``0.9 / (1 + 1 / p) * (l + l' - 4)``, which is less than l', the votes they share."""
    return F.greatest(F.lit(0), F.floor(F.lit(0.9 / (1 + 100 / percent)) * (F.floor(n / 20) - 1)))


def regions_of(sets: DataFrame, percent: int) -> DataFrame:
    """(region, node, n, own, w): the regions with at least two nodes and their shingles; ``own`` is the least id of the node's documents."""
    known = sets.where(F.col("n") > 0)
    rows = known.select("node", F.explode("prefix").alias("s"))
    pivot = rows.groupBy("s").agg(F.min("node").alias("region"), F.max("node").alias("last")).where(F.col("region") < F.col("last")).drop("last")
    documents = known.groupBy("node").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.min("id").alias("own"))
    votes = (rows.join(pivot, "s").groupBy("node", "region").agg(F.count("*").alias("votes")).join(documents, "node")
             .withColumn("votes", F.col("votes") / F.col("copies")))           # the copies of a set vote alike
    of_node = Window.partitionBy("node")
    ranked = (votes.withColumn("total", F.sum("votes").over(of_node))
              .withColumn("before", F.sum("votes").over(of_node.orderBy(F.desc("votes"), "region").rowsBetween(Window.unboundedPreceding, -1))))
    # a partner of p * n shingles shares at least 1 + p * n / 20 of the prefix
    enough = F.col("total") >= 1 + F.floor(F.col("n") * percent / 2000)
    member = checkpointed(ranked.where(enough & (F.coalesce("before", F.lit(0)) < F.col("total") - spare(F.col("n"), percent))).select("region", "node", "n", "own"), "regions")
    weight = member.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where(F.col("m") > 1)
    return checkpointed(member.join(weight.drop("m"), "region"), "regions")


# ---- level 2: large regions ------------------------------------------------------------------

def split_large(rows: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges, rows of small regions that are left) of large regions; rows are (region, node, n, set)."""
    r, pivots_wanted, edges, small = 1 - percent / 100, 16, None, None
    rows = checkpointed(rows.withColumn("comp", F.col("node")), "largeregions")

    def measure(key, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"region": members["region"], "node": members["node"], "to": None, "near": None})
        if len(members) and len(pivots):
            own = [np.asarray(x) for x in members["set"]]
            n = np.array([len(x) for x in own])
            values, flat = np.unique(np.concatenate(own), return_inverse=True)
            starts, mark = np.concatenate(([0], np.cumsum(n)[:-1])), np.zeros(len(values), np.int32)
            distance, links = np.empty((len(pivots), len(own))), np.empty((len(pivots), len(own)), bool)
            for i, p in enumerate(pivots["set"]):
                at = np.minimum(np.searchsorted(values, p), len(values) - 1)
                inter = shared_with(at[values[at] == p], flat, starts, mark)
                distance[i] = 1 - inter / (n + len(p) - inter)
                links[i] = linked(inter, n, len(p), percent)
            names = pivots["node"].to_numpy()
            cells = distance <= distance.min(axis=0) + 2 * r + 1e-9
            out["to"] = [names[x] for x in links.T]
            out["near"] = [names[x] for x in cells.T]
        return out

    while rows.head(1):
        # pivots come from outside the largest component of their region
        sizes = rows.groupBy("region", "comp").agg(F.count("*").alias("m"))
        total = sizes.groupBy("region").agg(F.sum("m").alias("m"), F.max_by("comp", "m").alias("largest"), F.max("m").alias("most")).where(F.col("m") > F.col("most"))
        total = checkpointed(total, "largesizes")
        rows = rows.join(total, "region")
        drawn = (F.col("comp") != F.col("largest")) & (F.pmod(F.xxhash64("node", F.lit(pivots_wanted)), F.col("m") - F.col("most")) < pivots_wanted)
        pivots = checkpointed(rows.where(drawn).select("region", "node", "set", "m"), "largepivots")
        blocks = F.ceil(F.col("m") / 1024).cast("int")
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        # each block of members meets blocks of pivots: both are bounded
        everywhere = (pivots.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, pivots_wanted // 128))))
                      .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("region", "block", "part", "node", "set"))
        parts = F.explode(F.sequence(F.lit(0), F.lit(max(1, pivots_wanted // 128) - 1))).alias("part")
        found = checkpointed(
            dealt.select("region", "block", "node", "set", parts).groupBy("region", "block", "part")
            .cogroup(everywhere.groupBy("region", "block", "part")).applyInPandas(measure, "region long, node long, to array<long>, near array<long>"), "largelinks")
        # a node links to its first pivot, and that pivot to the others of the node
        first = found.where(F.size("to") > 0).select(F.col("to")[0].alias("b"), "node", "to")
        new = (first.select(F.col("node").alias("a"), "b").union(first.select(F.explode("to").alias("a"), "b"))).where(F.col("a") != F.col("b")).distinct()
        edges = new if edges is None else edges.union(new)
        edges = checkpointed(edges, "largeedges")
        label = components(edges)
        left = (rows.drop("m", "largest", "most", "comp").join(pivots.select("region", "node"), ["region", "node"], "left_anti")
                .join(label.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        near = found.where(F.size("near") > 0).select("region", "node", F.explode("near").alias("cell"))
        growth = near.groupBy("region").agg(F.count("*").alias("all"), F.count_distinct("node").alias("own"), F.count_distinct("cell").alias("cells"))
        worth = growth.where((F.col("all") <= SPREAD * F.col("own")) & (F.col("cells") > 1)).select("region").withColumn("split", F.lit(True))
        left = left.join(worth, "region", "left")
        cells = left.where("split").join(near, ["region", "node"]).withColumn("region", F.xxhash64("region", "cell")).drop("cell", "split")
        left = checkpointed(left.where("split is null").drop("split").unionByName(cells), "largeregions")
        weight = left.groupBy("region").agg(F.sum("n").alias("w"), F.count_distinct("comp").alias("c")).where("c > 1")
        ready = left.join(weight.where(F.col("w") <= limit).select("region"), "region", "left_semi").select("region", "node", "n", "set")
        small = ready if small is None else small.unionByName(ready)
        rows = checkpointed(left.join(weight.where(F.col("w") > limit).select("region"), "region", "left_semi"), "largeregions")
        pivots_wanted *= 8
    return edges, small


# ---- components --------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component."""
    e = checkpointed(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    sign = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        e = checkpointed(large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root).where(F.col("a") != F.col("b")).distinct(), "edges")
        was, sign = sign, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


# ---- the join ------------------------------------------------------------------------------------

def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", limit: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = prefixes(texts, words, percent)
    members = regions_of(sets, percent)
    # one document of each node gives its text; few members are told to all tasks, many are joined by sorting
    wanted = F.broadcast(members) if members.count() <= FEW else members
    rows = texts.join(wanted, F.col("own").eqNullSafe(F.col("id"))).select("region", "node", "n", "text", "w")

    def join(batches):
        for _, nodes, found in _regions(batches, words):
            root = join_region(found, percent)
            hit = [i for i, x in enumerate(root) if i != x]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in hit], pa.int64()), pa.array([nodes[root[i]] for i in hit], pa.int64())], ["a", "b"])

    def with_sets(batches):
        memo = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingle_set(t, words, memo) for t in part.column(3).to_pylist()]
                same = np.array([node_of(h) == x for h, x in zip(own, part.column(1).to_pylist())], bool)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([h.view(np.int64) for h in own], pa.list_(pa.int64()))], ["region", "node", "n", "set"]).filter(pa.array(same))

    def join_sets(batches):
        for pdf in batches:
            root = join_region([np.asarray(x) for x in pdf["set"]], percent) if len(pdf) > 1 else [0]
            nodes = pdf["node"].to_numpy()
            hit = [i for i, x in enumerate(root) if i != x]
            yield pd.DataFrame({"a": nodes[hit], "b": nodes[[root[i] for i in hit]]})

    edges = rows.where(F.col("w") <= limit).select("region", "node", "text").repartition("region").sortWithinPartitions("region").mapInArrow(join, "a long, b long")
    if members.where(F.col("w") > limit).head(1):
        large = rows.where(F.col("w") > limit).select("region", "node", "n", "text").mapInArrow(with_sets, "region long, node long, n int, set array<long>").dropDuplicates(["region", "node"])
        stars, small = split_large(large, percent, limit)
        edges = edges.union(stars)
        edges = edges.union(small.groupBy("region").applyInPandas(lambda pdf: next(join_sets([pdf])), "a long, b long"))
    label = components(edges)
    known = sets.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("first")).join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = known.join(smallest, "root").select("node", "component_id")
    return sets.join(of_node, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of its component.

    Documents without words stay, and so do rows without an id (nothing tells them apart) and all rows that repeat a kept id."""
    found = jaccard_join(docs, words, percent, id_col, text_col)
    first = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
