"""Note files whose headers differ, label cells that are no lists, awkward labels."""

from curata.session import shared_dir
from curata.sources import files as FS


def write(spark, path, name, text):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(f"{path}/{name}")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


def test_columns_are_read_by_name(spark):
    d = shared_dir(spark, "t-headers")
    write(spark, d, "a_train.csv", "text,labels,subject_id\n\"one\ntwo \"\"q\"\"\",\"['X', 'Y']\",1\nthree,[],2\n")
    write(spark, d, "b_dev.csv", "subject_id,TEXT,labels\n7,four,\"['Y']\"\n8,five,oops\n")
    rows = sorted((r["task"], r["split"], r["row_idx"], r["text"], r["labels"], r["subject_id"]) for r in FS.scan_task_dir(spark, d).collect())
    assert rows == [("a", "train", 0, 'one\ntwo "q"', ["X", "Y"], "1"), ("a", "train", 1, "three", [], "2"),
                    ("b", "dev", 0, "four", ["Y"], "7"), ("b", "dev", 1, "five", None, "8")]
    assert [tuple(r) for r in FS.rejected_notes(spark, d).collect()] == [("b_dev.csv", 1, "oops")]


def test_equal_file_names_in_two_folders(spark):
    d = shared_dir(spark, "t-folders")
    for part in ("x", "y"):
        write(spark, d, f"file_key={part}_train.csv/part-0.csv", f"text,labels\n{part}1,[]\n{part}2,[]\n")
    rows = sorted((r["task"], r["row_idx"], r["text"]) for r in FS.scan_task_dir(spark, d).collect())
    assert rows == [("x", 0, "x1"), ("x", 1, "x2"), ("y", 0, "y1"), ("y", 1, "y2")]


def test_awkward_labels_come_back(spark):
    d = shared_dir(spark, "t-labels")
    labels = ["a\\b", "line\nbreak", "it's \"both\"", "plain"]
    spark.createDataFrame([("t", labels)], "text string, labels array<string>").transform(lambda x: FS.write_notes_csv(x, d) or x)
    assert FS.read_notes_csv(spark, d).first()["labels"] == labels
