"""Exact top-k search by inner product over one KD-tree per shard.

The candidates are dealt into shards of about ``shard_rows`` rows by a hash of their place in the scan, so many rows of one
id are spread too.  Each shard becomes one KD-tree: every node is split at the median of its widest
dimension and keeps the tight bounding box of its points and their smallest id.  For a
query q the best inner product inside a box is at most ``max(q,0).hi + min(q,0).lo``;
a tree is walked best bound first and a node is skipped once its bound cannot beat the
kth result known so far.

Queries are packed into blocks of ``block_rows``.  In a first round each block visits one
shard only; the kth (score, id) found there goes with the block to all shards in the
second round.  The small blocks go to the trees: a tree meets ``CHUNK`` blocks at a time in one task, so it is copied once
for that many blocks, and not at all while there are no more of them.

Defined results
- null vectors, vectors with a null or non-finite component, and rows without an id take no part;
- a query never finds rows of its own id; repeated candidate rows all count;
- a query row that occurs twice gives its results twice;
- vectors are compared only with vectors of the same length (length 0: every score is 0);
- equal scores go to the smaller id; fewer than k candidates give fewer rows;
- scores beyond the range of a long count as its ends;
- empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.session import checkpointed

_TREE = "dim int, shard long, ids binary, points binary, lo binary, hi binary, nodes binary"
_BLOCK = "dim int, block long, qids binary, qvecs binary"
CHUNK = 16          # query blocks that a tree meets in one task
_FOUND = "dim int, block long, pos int, query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, vec): floor(scale * component) of every usable vector."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vec"))


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int) -> tuple:
    """Points in tree order, the boxes and (left child, right child, start, end, smallest id) of every node."""
    n, dim = points.shape
    order = np.arange(n)
    lo, hi, nodes, todo = [], [], [], [(0, n, -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = points[order[start:end]]
        lo.append(own.min(axis=0))
        hi.append(own.max(axis=0))
        me = len(nodes)
        nodes.append([-1, -1, start, end, int(ids[order[start:end]].min())])
        if parent >= 0:
            nodes[parent][side] = me
        spread = hi[-1] - lo[-1]
        if end - start > leaf_rows and dim and spread.max() > 0:
            mid = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, int(spread.argmax())], mid)]
            todo += [(start + mid, end, me, 1), (start, start + mid, me, 0)]
    return ids[order], points[order], np.array(lo), np.array(hi), np.array(nodes, dtype=np.int64)


def _exact(values: int, dim: int):
    """The number type in which sums of ``dim`` products up to ``values`` are exact."""
    return np.float64 if values * max(dim, 1) < 2**53 else np.int64 if values * max(dim, 1) < 2**63 else object


def _in_range(scores: np.ndarray) -> np.ndarray:
    """Python numbers beyond a long become its ends."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


class TopK:
    """The best k (score, id) of one query so far, and the bound that others must beat."""

    def __init__(self, k: int, bound: tuple[int, int] | None = None):
        self.k, self.bound, self.found = k, bound, []

    def beats(self, score: int, vec_id: int) -> bool:
        return self.bound is None or score > self.bound[0] or (score == self.bound[0] and vec_id <= self.bound[1])

    def add(self, scores, ids) -> None:
        self.found = heapq.nsmallest(self.k, self.found + [(-int(s), int(i)) for s, i in zip(scores, ids)])
        if len(self.found) == self.k:
            score, vec_id = -self.found[-1][0], self.found[-1][1]
            if self.beats(score, vec_id):
                self.bound = (score, vec_id)


def search_tree(tree: tuple, qids: np.ndarray, queries: np.ndarray, best: list[TopK]) -> None:
    """Best-first walk of one tree for every query of a block."""
    ids, points, lo, hi, nodes = tree
    kind = _exact(_largest(points) * _largest(queries), points.shape[1])
    points, q = points.astype(kind), queries.astype(kind)
    zero = np.zeros_like(q)
    bounds = _in_range(np.maximum(q, zero) @ hi.astype(kind).T + np.minimum(q, zero) @ lo.astype(kind).T)
    for row, own in enumerate(qids):
        top, bound = best[row], bounds[row]
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if top.bound is not None and -b < top.bound[0]:
                break
            left, right, start, end, least = nodes[node]
            if not top.beats(-b, least):
                continue
            if left >= 0:
                heapq.heappush(heap, (-bound[left], int(left)))
                heapq.heappush(heap, (-bound[right], int(right)))
                continue
            scores, members = _in_range(points[start:end] @ q[row]), ids[start:end]
            keep = members != own
            if top.bound is not None:
                keep &= scores >= top.bound[0]
            scores, members = scores[keep], members[keep]
            if len(scores) > top.k:      # enough to sort those that can be among the k best
                whole = scores.astype(np.int64) if kind is np.float64 else scores       # sums below 2^53 are whole numbers
                part = np.lexsort((members, -whole))[: top.k] if kind is not object else sorted(range(len(whole)), key=lambda i: (-whole[i], members[i]))[: top.k]
                scores, members = scores[part], members[part]
            if len(scores):
                top.add(scores, members)


def kd_topk(candidates: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096,
            leaf_rows: int = 128, block_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (id, vec) of each query (id, vec)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pts = np.array(pdf["vec"].tolist(), dtype=np.int64).reshape(len(pdf), dim)
        ids, pts, lo, hi, nodes = build_tree(pdf["id"].to_numpy(np.int64), pts, leaf_rows)
        small = np.int32 if _largest(pts) < 2**31 else np.int64
        return pd.DataFrame({"dim": [dim], "shard": [int(pdf["shard"].iloc[0])], "ids": [ids.tobytes()], "points": [pts.astype(small).tobytes()],
                             "lo": [lo.tobytes()], "hi": [hi.tobytes()], "nodes": [nodes.tobytes()]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        q = np.array(pdf["vec"].tolist(), dtype=np.int64).reshape(len(pdf), dim)
        return pd.DataFrame({"dim": [dim], "block": [int(pdf["block"].iloc[0])], "qids": [pdf["id"].to_numpy(np.int64).tobytes()], "qvecs": [q.tobytes()]})

    def tree_of(r) -> tuple:
        dim, ids = r.dim, np.frombuffer(r.ids, dtype=np.int64)
        small = np.int32 if len(r.points) == 4 * dim * len(ids) else np.int64
        nodes = np.frombuffer(r.nodes, dtype=np.int64).reshape(-1, 5)
        box = [np.frombuffer(x, dtype=np.int64).reshape(len(nodes), dim) for x in (r.lo, r.hi)]
        return ids, np.frombuffer(r.points, dtype=small).reshape(len(ids), dim).astype(np.int64), *box, nodes

    def search(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in trees.itertuples(index=False):
            tree = tree_of(t)
            for r in blocks.itertuples(index=False):
                qids = np.frombuffer(r.qids, dtype=np.int64)
                q = np.frombuffer(r.qvecs, dtype=np.int64).reshape(len(qids), r.dim)
                known = {p: (s, i) for p, s, i in zip(*([] if x is None else x for x in (r.kpos, r.kscore, r.kid)))}
                best = [TopK(k, known.get(p)) for p in range(len(qids))]
                search_tree(tree, qids, q, best)
                out += [(r.dim, r.block, p, int(qids[p]), i, -s) for p, b in enumerate(best) for s, i in b.found]
        return pd.DataFrame(out, columns=["dim", "block", "pos", "query_id", "vec_id", "score"])

    def meet(blocks: DataFrame, trees: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "chunk"]
        return blocks.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(search, _FOUND)

    with_dim = [c.withColumn("dim", F.size("vec")) for c in (candidates, queries)]
    n, m = candidates.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(m / block_rows))
    trees = checkpointed(
        with_dim[0].withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy("dim", "shard").applyInPandas(build, _TREE), "kdtrees")
    packed = checkpointed(
        with_dim[1].withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(pack, _BLOCK), "kdqueries")

    # first round: every block and one shard, the block's number modulo the shards
    nothing_known = {c: F.lit(None).cast(t) for c, t in (("kpos", "array<int>"), ("kscore", "array<long>"), ("kid", "array<long>"))}
    one = packed.withColumn("shard", F.pmod("block", F.lit(shards))).withColumn("chunk", F.lit(0)).withColumns(nothing_known)
    first = meet(one, trees.where(F.col("shard") < blocks).withColumn("chunk", F.lit(0)))
    by_query = Window.partitionBy("dim", "block", "pos").orderBy(F.desc("score"), "vec_id")
    bounds = (first.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") == k)
              .groupBy("dim", "block").agg(F.collect_list(F.struct("pos", "score", "vec_id")).alias("x"))
              .select("dim", "block", F.col("x.pos").alias("kpos"), F.col("x.score").alias("kscore"), F.col("x.vec_id").alias("kid")))
    # the stated queries against all rows, in blocks: every block goes to every shard, every tree to the chunks of blocks
    chunks = max(1, math.ceil(blocks / CHUNK))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = packed.join(bounds, ["dim", "block"], "left").withColumn("chunk", F.floor(F.col("block") / CHUNK)).withColumn("shard", to_all(shards))
    found = meet(sent, trees.withColumn("chunk", to_all(chunks))).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
