"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curata.llm import prefix_trie as T
from curata.session import checkpointed

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rebuilt: dict[int, list[tuple[str, str]]]):
    """Rows of ``COLUMNS`` from {conv_id: turns}."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, own in members.items())


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def rebuilt_of(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, role, sha), role, text))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    return out


def trie(spark, rows, shard_turns=T.SHARD_TURNS):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, ids string")
    numbered = checkpointed(T.numbered_turns(df))
    conv = F.col("conv_id")
    return T.prefix_trie(T.regrafted(numbered, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9), shard_turns)


def random_rows(seed, convs, words, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if c % 7 == 5:
            continue                                     # bases that are absent
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", *("w" * k + "é" for k in range(words))])))
    return rows


@pytest.mark.parametrize("shard_turns", [T.SHARD_TURNS, 60, 8])
def test_equals_the_plain_trie(spark, shard_turns):
    rows = random_rows(4, 140, 1) + [(c, t, "user", "same") for c in range(1000, 1060) for t in range(12)]      # a large group of copies
    rows += [(None, 0, "user", "no conversation"), (3, None, "user", "first"), (3, None, "user", "first"), (2000, 2, "user", "z" * 20_000)]
    assert found(trie(spark, rows, shard_turns)) == plain(rebuilt_of(rows))


def test_many_random_tries_in_many_shards(spark):
    """The shards' parts, built and merged without Spark's own jobs."""
    rng = random.Random(8)
    for trial in range(150):
        seqs = sorted({tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 25))})
        cuts = sorted(rng.sample(range(1, len(seqs)), min(len(seqs) - 1, rng.randint(0, 5))))
        shards = [seqs[a:b] for a, b in zip([0, *cuts], [*cuts, len(seqs)])]
        import numpy as np
        import pandas as pd
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        total = defaultdict(lambda: [0, 0, 0, 0])
        single = []
        for i, own in enumerate(shards):
            before = common(shards[i - 1][-1], own[0]) if i else -1
            after = common(own[-1], shards[i + 1][0]) if i + 1 < len(shards) else -1
            df = pd.DataFrame({"ids": [np.array(s) for s in own], "sizes": [np.array(s) + 1 for s in own], "members": [1 + len(s) % 2 for s in own],
                               "least": range(len(own)), "end_key": [str(s) for s in own]})
            for r in T.shard_nodes(df, before, after, after == len(own[-1])).itertuples():
                numbers = [r.n_convs, r.n_children, r.n_leaves, r.saved_tokens]
                if r.shared:
                    total[r.key, r.depth] = [x + y for x, y in zip(total[r.key, r.depth], numbers)]
                else:
                    single.append((r.depth, *numbers))
        whole = pd.DataFrame({"ids": [np.array(s) for s in seqs], "sizes": [np.array(s) + 1 for s in seqs], "members": [1 + len(s) % 2 for s in seqs],
                              "least": range(len(seqs)), "end_key": [str(s) for s in seqs]})
        want = sorted((r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in T.shard_nodes(whole, -1, -1, False).itertuples())
        assert sorted(single + [(d, *x) for (_, d), x in total.items()]) == want


def test_turnless_and_empty(spark):
    """Own turns end within the part that an absent base would give: the conversation has none and belongs to the root."""
    c = next(c for c in range(10_001, 10_100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert found(trie(spark, rows)) == plain({c: []}) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie(spark, rows[:0] or [(None, 0, "user", "a")]).count() == 0


def test_member_lists_of_several_blocks(spark):
    ids = [*range(0, 30_000, 3), 10 ** 12]
    df = spark.createDataFrame([("k", i) for i in ids] + [("other", 5)], "end_key string, conv_id long").repartition(7)
    rows = dict(map(tuple, T.member_digests(df).collect()))
    assert rows == {"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "other": hashlib.sha256(b"5").hexdigest()}
