"""CSV by blocks against the whole-file reader, with blocks of a few bytes."""

import random

import pytest

from curata.sources import files as FS
from curata.sources.csv_blocks import read_records

@pytest.fixture(params=[64, 100_000])
def block(spark, request):
    small = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3",
             "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng):
    text = "".join(rng.choice(["a", "é", '"', ",", "\n", "\r\n", " ", "bb", "'x'"]) for _ in range(rng.choice([0, 1, 3, 12, 60])))
    return text


def written(text):
    return '"' + text.replace('"', '""') + '"'


def test_same_rows_as_the_whole_file_reader(spark, tmp_path, block):
    rng = random.Random(block)
    for name, end, header in (("a_fold_1_train.csv", "\n", "TEXT,labels"), ("b c_fold_1_dev.csv", "\r\n", "labels,text,other")):
        n = header.count(",") + 1
        rows = [",".join(written(cell(rng)) if c != "labels" else written("['A', 'B']") for c in header.split(",")) for _ in range(12)]
        rows[3:3] = [""]                                              # a blank line between records
        (tmp_path / name).write_bytes((header + end + end.join(rows) + (end if n == 2 else "")).encode())
    key = lambda r: (r["file_name"], r["row_idx"])
    columns = ["file_name", "row_idx", "text", "labels", "other"]
    want = sorted(FS.read_notes_csv(spark, str(tmp_path)).select(*columns).collect(), key=key)
    got = sorted(FS.read_notes_csv(spark, str(tmp_path), by_blocks=True).select(*columns).collect(), key=key)
    # in a file whose lines end with \r\n the whole-file reader turns \r\n inside texts into \n; the block reader keeps it
    plain = lambda r: tuple(v.replace("\r\n", "\n") if isinstance(v, str) and r["file_name"].startswith("b") else v for v in r)
    assert len(got) == 24 and list(map(plain, got)) == list(map(plain, want))
    assert [r for r in got if r["file_name"].startswith("a")] == [r for r in want if r["file_name"].startswith("a")]


def test_records_that_span_many_blocks(spark, tmp_path, block):
    long = "x\n" * 100
    (tmp_path / "f.csv").write_text(f'text,n\n{written(long)},1\n"",2\nplain,3\n{written(long + chr(34))},4')
    rows = sorted((r["row_idx"], r["record"]) for r in read_records(spark, str(tmp_path)).collect())
    assert rows == [(0, "text,n"), (1, f"{written(long)},1"), (2, '"",2'), (3, "plain,3"), (4, f"{written(long + chr(34))},4")]
