"""The Jaccard join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from curata.llm.jaccard_join import components, jaccard_join, keep_first

SCHEMA = "doc_id long, text string"


def brute(rows, words, percent):
    """{doc_id: (n, component)} by comparing all pairs (ids distinct)."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    todo = True
    while todo:
        todo = False
        for a in sets:
            for b in sets:
                inter = len(sets[a] & sets[b])
                if comp[b] < comp[a] and inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                    comp[a], todo = comp[b], True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def corpus(seed, families=12, copies=12, vocabulary=400):
    rnd = random.Random(seed)
    passage = " ".join(f"p{rnd.randrange(50)}" for _ in range(60))
    rows = []
    for _ in range(families):
        base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(3, 160))]
        for _ in range(rnd.randrange(1, copies)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4])):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(9)}"
            rows.append(" ".join(own) + (" " + passage if rnd.random() < 0.2 else ""))
    rnd.shuffle(rows)
    return [*enumerate(rows), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "a b"), (9007, "a b c")]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed,words,percent,limit", [(1, 4, 85, 2_000_000), (2, 5, 80, 2_000_000), (3, 4, 85, 600), (4, 2, 60, 300)])
def test_against_all_pairs(spark, seed, words, percent, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("extra")).repartition(3)
    assert result(jaccard_join(docs, words, percent, limit=limit)) == brute(rows, words, percent)


def test_repeated_rows_and_null_ids(spark):
    t = "one two three four five six"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t), (8, "other words stand here now"), (None, None)], SCHEMA)
    found = sorted(((r.doc_id, r.component_id) for r in jaccard_join(docs, 4, 85).collect()), key=str)
    assert found == sorted([(5, 5), (5, 5), (None, 5), (7, 5), (8, 8), (None, None)], key=str)
    assert sorted((r.doc_id for r in keep_first(docs).collect()), key=str) == sorted([5, 5, 8, None, None], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(docs).collect() == []
    assert keep_first(docs).columns == ["doc_id", "text"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
