"""Null groups, null scores, equal ids in two tasks, text keys and crowded keys."""

import random
from collections import Counter

from pyspark.sql import functions as F

from curata.operators import labels as L
from curata.operators import metrics as M
from curata.operators import splits as S
from curata.operators.ranking import ordered_row_number, with_order_bucket

NOTES = "note_id string, task string, labels array<string>, text string"


def notes(spark, n=400):
    rnd = random.Random(4)
    rows = [(f"n{i % (n // 2)}", [None, "a", "b"][i * 3 // n], [f"L{int(rnd.paretovariate(0.6)) % 300}"] if i % 5 else [], f"t{i % 90}") for i in range(n)]
    return rows, spark.createDataFrame(rows, NOTES)


def test_ranks_keep_null_groups_and_text_keys(spark):
    rows, df = notes(spark)
    for out, col in ((S.seeded_order(df, ["task"], "note_id"), "rn"), (ordered_row_number(df, ["task"], "note_id", ["text"]), "rn")):
        got = out.collect()
        assert len(got) == len(rows)
        sizes = Counter(r["task"] for r in got)
        assert all(sorted(r[col] for r in got if r["task"] == t) == list(range(1, k + 1)) for t, k in sizes.items())
    ranked = ordered_row_number(df, ["task"], "note_id", ["text"]).where("task is null").orderBy("rn").collect()
    assert [(r["note_id"], r["text"]) for r in ranked] == sorted((r["note_id"], r["text"]) for r in ranked)
    assert S.batch_assign(df, ["task"], "note_id").count() == len(rows)


def test_crowded_keys_fill_many_buckets(spark):
    df = spark.range(20000).select(F.lit("x").alias("g"), (F.pow(F.rand(3), 6) * 0.02).alias("k")).unionByName(spark.createDataFrame([("x", 1e9), ("x", None)], "g string, k double"))
    sizes = [r["count"] for r in with_order_bucket(df, ["g"], "k").groupBy("__order_bucket").count().collect()]
    assert sum(sizes) == 20002 and max(sizes) < 2 * 20002 / 128


def test_stratified_split_of_rare_labels_and_equal_ids(spark):
    rows, df = notes(spark, 3000)
    out = S.stratified_split(df).collect()
    assert sorted((r["note_id"], r["task"] or "", r["text"]) for r in out) == sorted((r[0], r[1] or "", r[3]) for r in rows)
    for t in (None, "a", "b"):
        n = Counter(r["split"] for r in out if r["task"] == t)
        assert all(abs(n[s] / sum(n.values()) - share) <= 0.01 for s, share in zip(S.SPLITS, S.SPLIT_SHARES))


def test_missing_scores_take_no_part(spark):
    cells = spark.createDataFrame([(None, 0, 1, 1, 0.9), (None, 1, 1, 0, None), (None, 2, 1, 0, 0.2), (None, 3, 1, 1, None), (None, 4, 1, 1, 0.1), (None, 5, 2, 0, 0.5)],
                                  "task string, note_id int, label_id int, y_true int, y_prob double").withColumn("logit", F.coalesce("y_prob", F.lit(0.0)))
    assert [r["auroc"] for r in M.auroc_per_label(cells).collect()] == [0.5]
    report = M.label_report(cells).collect()
    assert len(report) == 2 and {r["auroc_micro"] for r in report} == {0.5} and all(r["loss"] is not None for r in report)
    assert M.exact_match(cells.fillna(0.0, ["y_prob"])).count() == 1


def test_all_means_no_cap(spark):
    df = spark.createDataFrame([("x", "train", i) for i in range(5)] + [("y", "train", i) for i in range(3)], "task string, split string, note_id int")
    assert S.head_per_split(df, L.split_size_cap(df, {"train": "all"}), "note_id").count() == 8
    assert S.head_per_split(df, L.split_size_cap(df, {"train": 2}), "note_id").count() == 4
    assert S.head_per_group(df, ["task", "split"], "note_id", 2000).count() == 8


def test_dedup_text_keeps_the_smallest_key(spark):
    rows, df = notes(spark)
    got = S.dedup_text(df).collect()
    best = {}
    for note, task, _, text in rows:
        best[task, text] = min(note, best.get((task, text), note))
    assert {(r["task"], r["text"]): r["note_id"] for r in got} == best and len(got) == len(best)


def test_half_written_dictionary_version_is_written_again(spark):
    from curata.session import path_exists, shared_dir
    from curata.streaming import labels as SL
    store = shared_dir(spark, "t-half")
    spark.createDataFrame([], SL.DICT_SCHEMA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store}/delta/0")
    assert path_exists(spark, f"{store}/delta/0") and not path_exists(spark, f"{store}/delta/0/_SUCCESS")
    batch = spark.createDataFrame([(1, ["B", "A"])], "note_id long, labels array<string>")
    SL.dictionary_batch_writer(store)(batch, 0)
    assert sorted(tuple(r) for r in SL.latest_dictionary(spark, store).collect()) == [(0, "A"), (1, "B")]


def test_rank_without_groups(spark):
    df = spark.createDataFrame([(f"k{i * 7 % 50:02d}", float(i)) for i in range(50)], "a string, b double")
    assert [r["rn"] for r in ordered_row_number(df, [], "a").orderBy("a").collect()] == list(range(1, 51))
    assert [r["rn"] for r in ordered_row_number(df, [], "b").orderBy("b").collect()] == list(range(1, 51))


def test_equal_ids_of_tasks_stay_apart(spark):
    """Two tasks and a null one use the same note ids; ids, texts and labels must not mix."""
    from curata.operators import text as TX
    rows = [("a", 1, "x y z", ["A", "B"]), ("b", 1, "y", ["B"]), (None, 1, "z z w", []), ("a", 2, None, ["A"])]
    df = spark.createDataFrame(rows, "task string, note_id long, text string, labels array<string>").repartition(3)
    vocab = TX.build_vocab(df)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids == {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "z": 4, "y": 5, "w": 6, "x": 7}
    for head in (0, 1, 2, 100):                      # all rare, some rare, none rare
        enc = {(r["task"], r["note_id"]): (r["input_ids"][:r["n_tokens"]], sum(r["attention_mask"])) for r in TX.encode_tokens(df, vocab, max_len=6, head_words=head).collect()}
        assert enc == {("a", 1): ([1, 7, 5, 4, 2], 5), ("b", 1): ([1, 5, 2], 3), (None, 1): ([1, 4, 4, 6, 2], 5), ("a", 2): ([1, 2], 2)}
    small = TX.build_vocab(df, min_count=2)
    unk = {(r["task"], r["note_id"]): r["input_ids"][:r["n_tokens"]] for r in TX.encode_tokens(df, small, head_words=1).collect()}
    assert unk[("a", 1)] == [1, 3, 5, 4, 2] and unk[(None, 1)] == [1, 4, 4, 3, 2]
    assert TX.encode_tokens(df.limit(0), small).count() == 0
    twice = TX.encode_tokens(df.unionByName(df), vocab, head_words=1)
    assert twice.count() == 8 and twice.distinct().count() == 4
    feats = {(r["task"], r["note_id"]): r["weight"] for r in TX.hash_features(df, dim=1).collect()}
    assert feats == {("a", 1): 1.0, ("b", 1): 1.0, (None, 1): 1.0}
    d = L.label_dictionary(df)
    want = {("a", 1): [0, 1], ("b", 1): [1], (None, 1): [], ("a", 2): [0]}
    for out in (L.labels_to_ids(df, d), L.labels_to_ids(df, d, carry=[])):
        assert {(r["task"], r["note_id"]): r["label_ids"] for r in out.collect()} == want
    names = L.ids_to_labels(L.multi_hot(L.labels_to_ids(df, d), 2), d)
    assert {(r["task"], r["note_id"]): r["decoded"] for r in names.collect()} == {k: ["AB"[i] for i in v] for k, v in want.items()}
    ex = df.select("task", "note_id", F.lit("train").alias("split"), F.explode("labels").alias("label"))
    assert {r["label"]: r["positives"] for r in L.split_support_by_label(ex).collect()} == {"A": 2, "B": 2}
    scores = df.select("task", "note_id", F.lit(1).alias("label_id"), F.lit(0.5).alias("y_prob"))
    truth = df.where("task = 'b'").select("task", "note_id", F.lit(1).alias("label_id"))
    assert {(r["task"], r["note_id"]): r["y_true"] for r in M.align_predictions(scores, truth).collect()} == {("a", 1): 0, ("b", 1): 1, (None, 1): 0, ("a", 2): 0}


def test_range_ranks_split_ties(spark):
    from curata.operators.ranking import range_row_number
    rows = [(i % 3 if i % 7 else None, 1 if i % 10 else i, f"t{i * 37 % 5000:04d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, n int, t string").repartition(5)
    got = range_row_number(df, ["g"], [F.desc("n"), F.asc("t")], ranges=64).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r["rn"], -r["n"], r["t"]) for r in got if r["g"] == g)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted((-n, t) for k, n, t in rows if k == g)
    assert range_row_number(df.limit(0), [], [F.asc("t")]).count() == 0
