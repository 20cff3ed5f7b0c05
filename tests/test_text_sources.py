"""Sections, label literals, CSV edge cases and file-key rules."""

import json
import os
import tempfile

import pandas as pd

from curata.functions import text as X
from curata.operators import text as TX
from curata.sources import files as FS


def test_sections_edge_cases(spark):
    nl = "\n"
    rows = [
        (1, "no heading at all"),
        (2, f"Chief Complaint: pain{nl}more pain{nl}{nl}History 2: x{nl}{nl}Plan: rest"),
        (3, f"Present Illness: first{nl}{nl}second para{nl}{nl}Exam (x): y{nl}{nl}Plan: z"),
        (4, f"Medical History: last section without heading after"),
        (5, f"CHIEF COMPLAINT: cough{nl}{nl}Present Illness: fever{nl}{nl}Plan: go"),
        (6, f"Brief Hospital Course{nl}went home{nl}{nl}Discharge: ok"),
    ]
    df = TX.extract_sections(spark.createDataFrame(rows, "note_id long, text string"))
    got = {r["note_id"]: r for r in df.collect()}
    assert all(got[1][n] == "" for n, _ in X.SECTIONS)
    # a heading with a digit does not end a section
    assert got[2]["CHIEF_COMPLAINT"] == "pain more pain  History 2: x"
    # a heading with a bracket does not end it either; two paragraphs stay in one section
    assert got[3]["PRESENT_ILLNESS"] == "first  second para  Exam (x): y"
    assert got[4]["MEDICAL_HISTORY"] == ""
    assert got[5]["CHIEF_COMPLAINT"] == "cough" and got[5]["PRESENT_ILLNESS"] == "fever"
    # the heading without a colon keeps the text after it, line breaks as blanks
    assert got[6]["BRIEF_HOSPITAL_COURSE"] == "went home"
    kept = {r["note_id"] for r in TX.filter_has_section(df).collect()}
    assert kept == {2, 3, 5, 6}


def test_parse_label_list(spark):
    rows = [("['A', \"B'x\"]",), ("[]",), ("['unterminated",), ("[0.0, 1.0]",)]
    df = spark.createDataFrame(rows, "c string")
    got = [r[0] for r in df.select(X.parse_label_list("c")).collect()]
    assert got[0] == ["A", "B'x"] and got[1] == [] and got[2] is None
    nums = df.select(X.parse_label_list("c", "double")).collect()[3][0]
    assert nums == [0.0, 1.0]
    back = df.limit(1).select(X.parse_label_list("c").alias("l")).select(X.render_label_list("l")).first()[0]
    assert json.loads(back) == ["A", "B'x"]          # a JSON array, which F1 reads back


def test_csv_quotes_and_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="curata-csv-")
    p = os.path.join(d, "x.csv_fold_1_train.csv")
    with open(p, "w") as f:
        f.write('TEXT,labels\n"he said ""hi""\nand left","[\'A\', ""B\'x""]"\nplain,[]\n')
    df = FS.read_notes_csv(spark, p)
    rows = sorted(df.collect(), key=lambda r: r["row_idx"])
    assert len(rows) == 2
    assert rows[0]["text"] == 'he said "hi"\nand left' and rows[0]["labels"] == ["A", "B'x"]
    assert rows[1]["labels"] == []
    k = FS.scan_task_dir(spark, d).select("key", "task", "split").first()
    assert tuple(k) == ("x.csv_fold_1_train", "x.csv_fold_1", "train")


def test_stratified_dir_requires_every_task(spark):
    d = tempfile.mkdtemp(prefix="curata-strat-")
    pd.DataFrame({"text": ["a", "b"], "labels": ["[1.0, 0.0]", "[0.0, 1.0]"]}).to_csv(
        os.path.join(d, "en_codes_fold_train.csv"), index=False)
    df = FS.scan_stratified_dir(spark, d, ["en"])
    r = df.orderBy("row_idx").collect()
    assert r[0]["key"] == "en_codes_train" and r[0]["labels"] == [1.0, 0.0]
    try:
        FS.scan_stratified_dir(spark, d, ["fr"])
        raise AssertionError("expected a missing-task error")
    except ValueError as e:
        assert "fr" in str(e)


def test_vocab_and_encoding(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "  A d "), (3, "")], "note_id long, text string")
    v = TX.build_vocab(docs, max_size=6)
    ids = {r["token"]: r["token_id"] for r in v.collect()}
    assert ids == {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "a": 4, "b": 5}
    enc = {r["note_id"]: r for r in TX.encode_tokens(docs, v, max_len=6).collect()}
    assert enc[1]["input_ids"] == [1, 4, 5, 4, 3, 2]            # cut to 4 tokens + CLS/SEP
    assert enc[2]["input_ids"] == [1, 4, 3, 2, 0, 0] and enc[2]["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert enc[3]["input_ids"] == [1, 2, 0, 0, 0, 0]


def test_blank_brackets_flag(spark):
    df = spark.createDataFrame([(1, "Chief Complaint: [] none\n\nPlan: x")], "note_id long, text string")
    assert TX.extract_sections(df).first()["CHIEF_COMPLAINT"] == "[] none"
    assert TX.extract_sections(df, blank_brackets=True).first()["CHIEF_COMPLAINT"] == ""


def test_a_note_in_parts_over_several_batches():
    """Parts of notes meet again, also when a batch ends inside a note; a note without words is a row."""
    import pyarrow as pa

    from curata.operators import text as TX

    parts = [(7, 0, ["a", "x"]), (7, 1, ["b", "a"]), (7, 2, ["y"]), (8, 0, []), (None, 0, ["b"]), (9, 0, ["z", "a"]), (9, 1, ["a"])]
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()))
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[i:i + size]), kinds)], ["note_id", "p", "w"]) for i in range(0, len(parts), size)]
        out = [r for b in TX.look_up_notes(iter(batches), pa.array(["a", "b"]), ["note_id"], 100) for r in b.to_pylist()]
        assert [(r["note_id"], r["__row"], r["__ids"], [(x["pos"], x["token"]) for x in r["__rest"]]) for r in out] == [
            (7, 100, [4, None, 5, 4, None], [(1, "x"), (4, "y")]), (8, 101, [], []), (None, 102, [5], []), (9, 103, [None, 4, 4], [(0, "z")])]
    assert list(TX.look_up_notes(iter([]), pa.array(["a"]), ["note_id"])) == []
