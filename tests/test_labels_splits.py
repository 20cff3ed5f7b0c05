"""Labels, dictionary, splits and ranks on hand-made rows and on sf0.001."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators import labels as L
from curata.operators import splits as S
from curata.operators.ranking import hash_bucket, seeded_hash, two_level_row_number
from curata.sources import tables as T


def notes(spark, rows):
    return spark.createDataFrame(rows, "note_id long, task string, labels array<string>")


def test_dictionary_repeated_and_unknown_labels(spark):
    n = notes(spark, [(1, "a", ["B", "A", "B"]), (2, "a", []), (3, "b", ["C"])])
    d = L.label_dictionary(n)
    assert [tuple(r) for r in d.orderBy("label_id").collect()] == [(0, "A"), (1, "B"), (2, "C")]
    ids = {r["note_id"]: r["label_ids"] for r in L.labels_to_ids(n, d).collect()}
    assert ids == {1: [1, 0, 1], 2: [], 3: [2]}
    mh = {r["note_id"]: r["labels_ohe"] for r in L.multi_hot(L.labels_to_ids(n, d), 3).collect()}
    assert mh[1] == [1.0, 1.0, 0.0] and mh[2] == [0.0, 0.0, 0.0]
    small = d.where(F.col("label") != "C")
    with pytest.raises(Exception, match="unknown label"):
        L.labels_to_ids(n, small, strict=True).collect()
    lenient = {r["note_id"]: r["label_ids"] for r in L.labels_to_ids(n, small, strict=False).collect()}
    assert lenient[3] == []


def test_multi_hot_round_trip(spark, sf):
    n = T.notes_orders(spark, sf)
    d = L.label_dictionary(n)
    mh = L.multi_hot(L.labels_to_ids(n, d), L.num_labels(d))
    back = L.ids_to_labels(mh, d).join(n, "note_id")
    bad = back.where(F.col("decoded") != F.sort_array(F.array_distinct("labels"))).count()
    assert bad == 0


def test_scorable_and_unused(spark):
    cells = spark.createDataFrame([("t", i, lab, y) for i in range(4) for lab, y in ((0, 0), (1, 1), (2, i % 2))],
                                  "task string, note_id long, label_id int, y_true int")
    sc = L.scorable_labels(cells).collect()
    assert [(r["label_id"], r["position"]) for r in sc] == [(2, 0)]
    d = spark.createDataFrame([(0, "A"), (1, "B")], "label_id int, label string")
    used = spark.createDataFrame([(0, "t", "train")], "label_id int, task string, split string")
    u = L.unused_labels(used, d, ["task", "split"], [("t", "train"), ("t", "dev")]).collect()
    flags = {(r["label_id"], r["split"]): r["used"] for r in u}
    assert flags == {(0, "train"): True, (1, "train"): False, (0, "dev"): False, (1, "dev"): False}


def test_two_level_rank_equals_window(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("note_id"), (F.col("id") % 3).alias("g"))
    h = seeded_hash(42, "note_id")
    a = two_level_row_number(df.withColumn("h", h), ["g"], hash_bucket(F.col("h")), [F.col("h"), F.col("note_id")])
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy(h, "note_id")))
    assert a.join(b, "note_id").where(F.col("rn") != F.col("rn2")).count() == 0


def test_stratified_split_disjoint_complete_and_padding(spark, sf):
    n = T.notes_orders(spark, sf).where(F.size("labels") > 0)
    s = S.stratified_split(n)
    assert s.count() == n.count() == s.select("note_id").distinct().count()
    shares = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    tot = sum(shares.values())
    assert abs(shares["train"] / tot - 0.66) < 0.03
    p = S.pad_split_to_multiple(s)
    assert p.count() == s.count()
    for r in p.groupBy("task", "split").count().collect():
        if r["split"] in ("dev", "test"):
            assert r["count"] % 8 == 0
    # already divisible: nothing moves the second time
    q = S.pad_split_to_multiple(p)
    assert q.join(p.withColumnRenamed("split", "s0"), ["note_id"]).where(F.col("split") != F.col("s0")).count() == 0


def test_leakage_and_intersection(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "dev"), (3, "train"), (3, "dev"), (3, "test")],
                               "subject_id long, split string")
    got = {(r["split_a"], r["split_b"]): r["shared_subjects"] for r in S.split_leakage(df).collect()}
    assert got == {("dev", "test"): 1, ("dev", "train"): 1, ("test", "train"): 2}
    assert sorted(r[0] for r in S.subjects_intersect(df, "train", "test").collect()) == [1, 3]
    none = spark.createDataFrame([(1, "train"), (2, "test")], "subject_id long, split string")
    assert all(r["shared_subjects"] == 0 for r in S.split_leakage(none).collect())


def test_batches(spark):
    df = spark.range(0, 21).select(F.col("id").alias("note_id"), F.lit("t").alias("task"))
    b = {r["note_id"]: r["batch_id"] for r in S.batch_assign(df, ["task"], "note_id").collect()}
    assert b[0] == 0 and b[7] == 0 and b[8] == 1 and b[20] == 2


def test_two_level_dictionary_equals_global(spark, sf):
    n = T.notes_orders(spark, sf)
    a = {tuple(r) for r in L.label_dictionary(n).collect()}
    b = {tuple(r) for r in L.label_dictionary(n, two_level=True).collect()}
    assert a == b and len(a) > 0
    odd = spark.createDataFrame([(1, ["é", "e", "Z", "a", "ab", "b", ""])], "note_id long, labels array<string>")
    assert ({tuple(r) for r in L.label_dictionary(odd).collect()}
            == {tuple(r) for r in L.label_dictionary(odd, two_level=True).collect()})


def test_split_of_wide_notes_equals_narrow(spark, sf):
    n = T.notes_orders(spark, sf).where(F.size("labels") > 0)
    narrow = S.stratified_split(n.select("note_id", "task", "labels"))
    wide = S.stratified_split(n.withColumn("text", F.repeat(F.lit("x"), 100)))
    assert set(wide.columns) >= {"subject_id", "text", "stratum", "split"}
    a = {(r["note_id"], r["split"], r["stratum"]) for r in narrow.collect()}
    b = {(r["note_id"], r["split"], r["stratum"]) for r in wide.collect()}
    assert a == b


def test_head_per_split_deals_the_rows_once(spark, monkeypatch):
    """One order by ranges, kept or cut by the caps; a frame without a cap stays whole."""
    from curata.operators import splits as S

    calls, deal = [], S.dealt_by_ranges
    monkeypatch.setattr(S, "dealt_by_ranges", lambda df, *a: calls.append(1) or deal(df, *a))
    rows = [(t, s, (i * 37) % 101) for t in (None, "a") for s in ("train", "dev", None) for i in range(100)]
    df = spark.createDataFrame(rows, "task string, split string, note_id long").repartition(4)
    caps = spark.createDataFrame([("train", 7), ("dev", None), (None, 0)], "split string, size long")
    got = sorted(S.head_per_split(df, caps, "note_id").collect(), key=str)
    size = {"train": 7, "dev": 100, None: 0}
    want = [x for t in (None, "a") for s in size for x in sorted(x for x in rows if x[:2] == (t, s))[:size[s]]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(calls) == 1
