"""Early stopping against the callback loop, the growing dictionary stream, and the head's gradient pass."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import experiments as E
from curata.operators import head as Hd
from curata.operators.catalogue import HeadCatalogue
from curata.session import checkpointed, folders_in, shared_dir
from curata.sources import tables as T
from curata.streaming import labels as SL


def callback_stop(values, patience=4):
    """The early-stopping callback as a loop: strict improvement, mode max."""
    best, wait = -float("inf"), 0
    for e, v in enumerate(values):
        if v > best:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= patience:
                return e
    return len(values) - 1


SERIES = {
    1: [0.1, 0.2, 0.3, 0.4, 0.5, 0.6],                 # rising
    2: [0.5] * 8,                                       # flat
    3: [0.5, 0.6, 0.4, 0.4, 0.4, 0.4, 0.9, 0.95],       # dip, then a rise after the stop epoch
    4: [0.3, 0.7, 0.7, 0.2, 0.7, 0.1, 0.1],             # tie at the maximum
}


def test_early_stop_and_best_epoch(spark):
    rnd = random.Random(3)
    series = dict(SERIES)
    for t in range(5, 45):
        series[t] = [round(rnd.random(), 1) for _ in range(rnd.randint(1, 15))]
    rows = [("s", t, e, v) for t, vals in series.items() for e, v in enumerate(vals)]
    m = spark.createDataFrame(rows, "study string, trial long, epoch int, value double")
    got = {r["trial"]: r for r in E.best_checkpoint(m).collect()}
    for t, vals in series.items():
        stop = callback_stop(vals)
        assert got[t]["stop_epoch"] == stop, t
        upto = vals[: stop + 1]
        assert got[t]["best_epoch"] == upto.index(max(upto))
    assert got[3]["stop_epoch"] == 5 and got[4]["best_epoch"] == 1
    long = {r["trial"]: r["stop_epoch"] for r in E.early_stop_long(m).collect()}
    assert long == {t: r["stop_epoch"] for t, r in got.items()}


def test_values_that_are_not_finite_or_missing(spark):
    nan, inf = float("nan"), float("inf")
    series = {1: [0.1, nan, 0.9], 2: [nan, 0.5], 3: [0.2, inf], 4: [0.3, None, 0.2, 0.1, 0.1, 0.9], 5: [None, None], 6: [0.4, -inf, 0.5], None: [0.1, 0.2]}
    rows = [("s", t, e, v) for t, vals in series.items() for e, v in enumerate(vals)]
    got = {r["trial"]: tuple(r)[2:] for r in E.trial_outcomes(spark.createDataFrame(rows, "study string, trial long, epoch int, value double")).collect()}
    # (stop, best epoch, best value): a value that is not finite stops its trial and is never the best
    assert got[1] == (1, 0, 0.1) and got[2] == (0, None, None) and got[3] == (1, 0, 0.2) and got[6] == (1, 0, 0.4)
    assert got[4] == (4, 0, 0.3)                                  # the epoch without a value is skipped, patience counts epochs
    assert got[5] == (1, None, None) and got[None] == (1, 1, 0.2)


def test_eval_grid_counts_equal_the_exploded_form(spark):
    notes = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "note_id long, task string")
    steps = spark.createDataFrame([(0, "a"), (1, "b")], "train_step int, trained_task string")
    wide = E.eval_grid(notes, steps).groupBy("train_step", "trained_task", "task").count()
    assert sorted(map(str, E.eval_grid_counts(notes, steps).collect())) == sorted(str(r).replace("count=", "n_notes=") for r in wide.collect())


def test_study_summary_ties_lowest_trial(spark):
    rows = [("s", 3, "COMPLETE", 0.9, {"learning_rate": 1.0}), ("s", 1, "COMPLETE", 0.9, {"learning_rate": 2.0}),
            ("s", 2, "PRUNED", 0.99, {"learning_rate": 3.0})]
    t = spark.createDataFrame(rows, "study string, trial long, state string, value double, "
                                    "params map<string,double>")
    r = E.study_summary(t, ["learning_rate"]).first()
    assert (r["n_trials"], r["n_pruned"], r["n_complete"], r["best_trial"]) == (3, 1, 2, 1)
    assert r["best_learning_rate"] == 2.0


def test_forgetting(spark):
    long = spark.createDataFrame([(0, "a", 0.8), (0, "b", 0.5), (1, "a", 0.6), (1, "b", 0.9)],
                                 "train_step int, eval_task string, value double")
    pos = spark.createDataFrame([("a", 0), ("b", 1)], "eval_task string, task_pos int")
    r = E.forgetting_summary(long, pos).first()
    assert r["avg_final"] == pytest.approx(0.75)
    assert r["backward_transfer"] == pytest.approx(-0.2)
    assert r["forgetting"] == pytest.approx(0.2)


def test_dictionary_stream_equals_batch_and_replay(spark):
    src, store, ck = shared_dir(spark, "t-src"), shared_dir(spark, "t-store"), shared_dir(spark, "t-ck")
    b0 = spark.createDataFrame([(1, ["B", "A"])], "note_id long, labels array<string>")
    b1 = spark.createDataFrame([(2, ["C", "A"]), (3, ["D"])], "note_id long, labels array<string>")
    b0.coalesce(1).write.parquet(src + "/b0")
    schema = "note_id long, labels array<string>"
    SL.run_dictionary_stream(spark, src + "/*", schema, store, ck)
    b1.coalesce(1).write.parquet(src + "/b1")
    SL.run_dictionary_stream(spark, src + "/*", schema, store, ck)
    got = sorted(tuple(r) for r in SL.latest_dictionary(spark, store).collect())
    assert got == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]          # new labels appended after old ids
    # replay of batch 1: nothing changes
    SL.dictionary_batch_writer(store)(b1, 1)
    assert sorted(tuple(r) for r in SL.latest_dictionary(spark, store).collect()) == got
    empty = spark.createDataFrame([], SL.DICT_SCHEMA)
    batch = SL.grow_dictionary(SL.grow_dictionary(empty, b0.select(F.explode("labels").alias("label"))),
                               b1.select(F.explode("labels").alias("label")))
    assert sorted(tuple(r) for r in batch.collect()) == got


def test_dictionary_deltas_bases_and_replays(spark):
    """Every batch writes its new labels only; replays and a half-written base change nothing."""
    rnd = random.Random(2)
    store = shared_dir(spark, "t-deltas")
    write = SL.dictionary_batch_writer(store, compact=3)
    batches = [[[f"L{rnd.randint(0, 40):02d}" for _ in range(rnd.randint(0, 4))] for _ in range(6)] for _ in range(11)]
    ids, known = {}, []
    for i, notes in enumerate(batches):
        df = spark.createDataFrame([(k, x) for k, x in enumerate(notes)], "note_id long, labels array<string>").repartition(3)
        write(df, i)
        new = sorted({x for own in notes for x in own} - ids.keys())
        assert spark.read.schema(SL.DICT_SCHEMA).parquet(f"{store}/delta/{i}").count() == len(new)
        ids.update({x: len(ids) + k for k, x in enumerate(new)})
        known.append(df)
        for again in {i, max(0, i - 1)}:                                # replays
            write(known[again], again)
        if i == 4:                                                      # a base that was cut off
            spark.createDataFrame([(99, "no")], SL.DICT_SCHEMA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store}/base/5")
        assert {r["label"]: r["label_id"] for r in SL.latest_dictionary(spark, store).collect()} == ids
    assert folders_in(spark, f"{store}/base") == ["5", "8"] and "0" not in folders_in(spark, f"{store}/delta")


def test_gradient_pass_equals_numpy(spark, sf):
    v = T.vectors(spark, sf).select("embedding", F.array("label").alias("label_ids"))
    pdf = v.toPandas()
    x = np.stack([np.asarray(e, dtype=float) for e in pdf["embedding"]])
    n_labels = int(max(i[0] for i in pdf["label_ids"])) + 1
    y = np.zeros((len(pdf), n_labels))
    for i, ids in enumerate(pdf["label_ids"]):
        y[i, ids] = 1.0
    w, b = np.zeros((n_labels, x.shape[1])), np.zeros(n_labels)
    for _ in range(3):
        p = 1 / (1 + np.exp(-(x @ w.T + b)))
        r = (p - y) / (len(x) * n_labels)
        w, b = w - 0.5 * r.T @ x, b - 0.5 * r.sum(0)
    head = Hd.Head.zeros(n_labels, x.shape[1])
    for _ in range(3):
        head = Hd.fit_linear_heads(v, [head], [0.5], [0], 1)[0]
    assert np.abs(head.weights - w).max() < 1e-12 and np.abs(head.bias - b).max() < 1e-12
    scored = Hd.score_linear_head(T.vectors(spark, sf), head).where(F.col("note_id") == int(pdf.index[0]))
    assert scored.count() == n_labels


def test_continual_run_reuses_catalogue_and_matches_by_equality(spark, sf):
    from curata.operators import continual as C
    from curata.plans.head_queries import _shape, vector_notes
    v = vector_notes(spark, sf)
    n_labels, dim = _shape(v)
    cat = shared_dir(spark, "t-heads")
    first = {(r["train_step"], r["eval_task"]): r["auroc_macro"]
             for r in C.continual_run(v, ["t0", "t1"], n_labels, dim, 2, 2.0, catalogue=cat).collect()}
    again = {(r["train_step"], r["eval_task"]): r["auroc_macro"]
             for r in C.continual_run(v, ["t0", "t1"], n_labels, dim, 2, 2.0, catalogue=cat).collect()}
    assert len(first) == 6 and first.keys() == again.keys()   # every step found in the catalogue
    for k, val in first.items():                               # same heads; sums may differ in the last bit
        assert again[k] == pytest.approx(val, abs=1e-12)
    heads = HeadCatalogue(spark, cat)
    assert [(m["step"], m["seq_key"]) for m in heads.manifests()] == [(0, "t0"), (1, "t0_t1")]
    assert heads.lookup("run", 1, "t0") is None                                   # no substring match
    assert heads.rows([heads.lookup("run", 1, "t0_t1")]).count() == n_labels


def test_catalogue_versions_are_whole(spark):
    """A writer that died before its manifest, and two writers of one version."""
    root = shared_dir(spark, "t-cat")
    cat = HeadCatalogue(spark, root)
    head = lambda v: spark.createDataFrame([(i, [v], v) for i in range(3)], "label_id int, weights array<double>, bias double")
    assert cat.manifests() == [] and cat.lookup("e", 0, "k") is None and cat.heads().count() == 0
    head(9.0).write.parquet(f"{root}/data/half")                                  # interrupted: data without a manifest
    assert cat.heads().count() == 0
    assert cat.publish(head(1.0), "e", 0, "k") and not cat.publish(head(2.0), "e", 0, "k")
    manifest = next(p for p in os.listdir(f"{root.removeprefix('file:')}/manifests") if p.endswith(".json"))
    draft = f"{root}/late.json"
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.write(cat._fs, cat._path(draft), bytearray(b"{}"))
    assert not cat._rename_new(draft, f"{root}/manifests/{manifest}")             # the second of two that checked at once
    assert {r["bias"] for r in cat.heads().collect()} == {1.0} and cat.heads().count() == 3
    assert cat.publish(head(3.0), "e", 0, "k", version=2, promoted=True) and cat.publish(head(4.0), "e", 0, "k", version=1, promoted=True)
    assert cat.publish(head(5.0), "e", 0, "k_l") and cat.publish(head(6.0), "f", 0, "k")
    assert cat.lookup("e", 0, "k")["version"] == 1 and {r["bias"] for r in cat.rows([cat.lookup("e", 0, "k")]).collect()} == {4.0}
    assert cat.heads().count() == 15


def test_promoted_weights_are_those_of_the_best_epoch(spark, sf):
    from curata.operators import continual as C
    from curata.plans.head_queries import _shape, vector_notes
    v = checkpointed(vector_notes(spark, sf).where("task = 't0'"))
    n_labels, dim = _shape(v)
    train, dev = v.where("split = 'train'"), v.where("split = 'dev'")
    grid, epochs = [(0.5, 0), (60.0, 0), (3.0, 2)], 9
    metrics, trials, snapshots = C.trial_grid(train, dev, grid, n_labels, dim, epochs, study="t0", patience=2)
    log = {}
    for r in metrics.orderBy("epoch").collect():
        log.setdefault(r["trial"], []).append(r["value"])
    for t, values in log.items():                                                  # each trial ends where the callback would stop it
        assert callback_stop(values, 2) == len(values) - 1, (t, values)
    assert any(len(values) < epochs for values in log.values())
    promoted = C.select_best_head(metrics, trials, snapshots, shared_dir(spark, "t-promote"), "e", 0, "t0", patience=2).collect()
    t, e = max(((t, e) for t, values in log.items() for e in range(len(values))), key=lambda x: (log[x[0]][x[1]], -x[0], -x[1]))
    assert {(r["trial"], r["epoch"], r["learning_rate"]) for r in promoted} == {(t, e, grid[t][0])} and len(promoted) == n_labels
    w, b = np.zeros((1, n_labels, dim)), np.zeros((1, n_labels))                   # the same trial alone, up to its best epoch
    for k in range(e + 1):
        g, gb, n = Hd.gradient_pass(train, w, b, "embedding", "label_ids")
        size = Hd.lr_at(k, *grid[t], epochs) / (n * n_labels)
        w, b = w - size * g, b - size * gb
    for r in promoted:
        assert np.abs(np.array(r["weights"]) - w[0, r["label_id"]]).max() < 1e-9 and abs(r["bias"] - b[0, r["label_id"]]) < 1e-9
