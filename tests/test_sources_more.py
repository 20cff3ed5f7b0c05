"""Three-split reader, encoding methods agree, hashed features are unit vectors, scan rebalance."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curata.operators import text as TX
from curata.sources import files as FS
from curata.sources import tables as T


def _write(d, name, rows):
    os.makedirs(os.path.join(d, name), exist_ok=True)
    pd.DataFrame(rows, columns=["notes", "labels"]).to_csv(os.path.join(d, name, "part.csv"), index=False)


def test_three_splits_optional_test_and_unlabelled(spark):
    d = tempfile.mkdtemp(prefix="curata-three-")
    _write(d, "train", [("a", "['X']"), ("b", "[]")])
    _write(d, "dev", [("c", "['Y', 'X']")])
    r = FS.read_three_splits(spark, d + "/{split}")
    got = sorted((x["text"], x["split"]) for x in r.collect())
    assert got == [("a", "train"), ("c", "dev")]             # empty label list dropped, test absent
    with pytest.raises(FileNotFoundError):
        FS.read_three_splits(spark, d + "/{split}", optional=())


def test_encoding_uses_the_whole_vocabulary(spark):
    rows = [(1, "b a a"), (2, " ".join(f"w{i:04d}" for i in range(1500))), (3, None), (4, "a")]
    docs = spark.createDataFrame(rows, "note_id long, text string")
    vocab = TX.build_vocab(docs)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    words = ["a", "b", *[f"w{i:04d}" for i in range(1500)]]
    assert [ids[w] for w in words] == list(range(4, 4 + len(words)))
    found = {r["note_id"]: r for r in TX.encode_tokens(docs, vocab, max_len=2000).collect()}
    for i, t in rows:
        expected = [1, *[ids[w] for w in (t or "").split()], 2]
        assert found[i]["n_tokens"] == len(expected) and found[i]["input_ids"][:len(expected)] == expected


def test_hash_features_unit_norm(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), "text")
    f = TX.hash_features(docs)
    norms = f.groupBy("note_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1.0) > 1e-9).count() == 0
    dense = TX.dense_features(f).first()["features"]
    assert len(dense) == 64


def test_row_index_per_file_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="curata-rows-")
    for f, n in (("a_fold_1_train.csv", 5), ("b_fold_1_dev.csv", 3), ("c_fold_1_test.csv", 4)):
        pd.DataFrame({"text": [f"{f}-{i}\nline" for i in range(n)], "labels": ["['X']"] * n}).to_csv(
            os.path.join(d, f), index=False)
    r = FS.scan_task_dir(spark, d).select("file_name", "row_idx", "text", "task", "split").collect()
    assert len(r) == 12
    for x in r:
        assert x["text"] == f"{x['file_name']}-{x['row_idx']}\nline"
    assert {(x["task"], x["split"]) for x in r} == {("a_fold_1", "train"), ("b_fold_1", "dev"), ("c_fold_1", "test")}


def test_result_sink_run_id_and_reader(spark):
    import re
    from curata.session import shared_dir
    path = shared_dir(spark, "t-results")
    long = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.7)], "train_step int, eval_task string, value double")
    FS.write_result_matrix(long, path, "a_b")
    FS.write_result_matrix(long.withColumn("value", F.col("value") + 0.1), path, "a_b_c")
    r = FS.read_result_dir(spark, path).collect()
    assert len(r) == 4 and all(x["file_name"].endswith(".parquet") for x in r)
    runs = {x["run"] for x in r}
    assert len(runs) == 2 and all(re.fullmatch(r"results_a_b(_c)?_\d{8}-\d{6}", x) for x in runs)


def test_split_size_cap_all_and_numbers(spark):
    from curata.operators import labels as L
    df = spark.createDataFrame([("x", "train")] * 5 + [("y", "train")] * 3 + [("x", "dev")] * 2 + [("y", "dev")],
                               "task string, split string")
    caps = {r["split"]: r["size"] for r in L.split_size_cap(df, {"train": 4, "dev": "all"}).collect()}
    assert caps == {"train": 3, "dev": None}
