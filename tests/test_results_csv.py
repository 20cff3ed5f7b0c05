"""Result CSVs: files of different columns, odd cells, missing steps, names, and a full round trip."""

import math
import os

import pandas as pd
import pytest

from curata.session import shared_dir
from curata.sources import results as RS


def test_round_trip_of_two_runs(spark):
    root = shared_dir(spark, "t-results")
    long = [(0, "b", 0.5), (0, "a", float("nan")), (2, "a", float("inf")), (2, "b", None), (3, "b", -0.25)]      # step 1 has no cell
    df = spark.createDataFrame(long, "train_step int, eval_task string, value double").repartition(3)
    path = RS.write_result_csv(df, root, "x_y", ["b", "a"], "20240102-030405")
    assert path == f"{root}/results_x_y_20240102-030405.csv"
    lines = open(path.removeprefix("file:")).read().splitlines()
    assert lines == ["b,a", "[{'torchmetrics.auroc': 0.5}],[{'torchmetrics.auroc': nan}]", ",", ",[{'torchmetrics.auroc': inf}]", "[{'torchmetrics.auroc': -0.25}],"]
    other = spark.createDataFrame([(0, "c", 1.0)], "train_step int, eval_task string, value double")
    RS.write_result_csv(other, root, "z", ["c", "b"], "20240102-030406")
    rows = RS.read_result_csvs(spark, root).collect()
    got = {(r["sequence"], r["train_step"], r["eval_task"]): (r["value"], r["cell"], r["eval_pos"], r["stamp"]) for r in rows}
    assert len(rows) == len(got) == 10
    assert got["x_y", 0, "b"] == (0.5, "[{'torchmetrics.auroc': 0.5}]", 0, "20240102-030405")
    assert math.isnan(got["x_y", 0, "a"][0]) and got["x_y", 2, "a"][0] == math.inf and got["x_y", 3, "b"][0] == -0.25
    assert got["x_y", 1, "a"][:2] == got["x_y", 2, "b"][:2] == (None, None)
    assert got["z", 0, "c"][0] == 1.0 and got["z", 0, "b"][0] is None


def test_files_written_by_pandas(spark, tmp_path):
    """Index-free frames with other columns, quoted names, numbers and texts that are no metric cells."""
    pd.DataFrame({"task one, two": ["[{'torchmetrics.auroc': 0.8, 'loss': 1}]", None], "val_auc": [0.1, 0.2]}).to_csv(tmp_path / "own name.csv", index=False)
    pd.DataFrame({"c": ["[broken", "[{'torchmetrics.auroc': -inf}]"]}).to_csv(tmp_path / "results_c_20240101-000000.csv", index=False)
    rows = {(r["file_name"], r["train_step"], r["eval_task"]): r for r in RS.read_result_csvs(spark, str(tmp_path)).collect()}
    own = [r for (f, *_), r in rows.items() if f.startswith("own")]
    assert len(own) == 4 and all(r["sequence"] is None and r["stamp"] is None for r in own)
    name = own[0]["file_name"]
    assert rows[name, 0, "task one, two"]["value"] == 0.8 and rows[name, 1, "task one, two"]["cell"] is None
    assert rows[name, 1, "val_auc"]["cell"] == "0.2" and rows[name, 1, "val_auc"]["value"] is None
    assert rows["results_c_20240101-000000.csv", 0, "c"]["value"] is None and rows["results_c_20240101-000000.csv", 1, "c"]["value"] == -math.inf


def test_unknown_task_and_bad_stamp(spark):
    df = spark.createDataFrame([(0, "a", 1.0)], "train_step int, eval_task string, value double")
    with pytest.raises(ValueError):
        RS.write_result_csv(df, shared_dir(spark, "t"), "s", ["b"], "20240102-030405")
    with pytest.raises(ValueError):
        RS.write_result_csv(df, shared_dir(spark, "t"), "s", ["a"], "2024")


def test_empty_run(spark):
    root = shared_dir(spark, "t-empty")
    df = spark.createDataFrame([], "train_step int, eval_task string, value double")
    RS.write_result_csv(df, root, "s", ["a"], "20240102-030405")
    assert os.listdir(root.removeprefix("file:")) and RS.read_result_csvs(spark, root).count() == 0
