"""Result tables as CSV (S8, S9): one file per run, one column per task, one row per trained step.

A run's file is ``results_{sequence}_{yyyyMMdd-HHmmss}.csv``.  It has no row index: the position of a row is its train step.
A metric cell is the text ``[{'torchmetrics.auroc': 0.83}]``.  These tables are as wide and as long as a
task sequence; the long form (run, train_step, eval_task, value) is what everything else works on.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.text import RESULT_METRIC, file_stem, parse_result_cell
from curata.session import shared_dir
from curata.sources.files import CSV_OPTIONS, headers_of, with_row_index

RUN_NAME = r"^results_(.*)_(\d{8}-\d{6})$"
LONG = "file_name string, sequence string, stamp string, train_step long, eval_pos int, eval_task string, cell string, value double"


def result_cell(value: Column | str, metric: str = RESULT_METRIC) -> Column:
    """A number as a metric cell; not-a-number is written ``nan``, null as an empty cell."""
    v = F.col(value) if isinstance(value, str) else value
    number = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf").otherwise(v.cast("string"))
    return F.when(v.isNotNull(), F.concat(F.lit("[{'" + metric + "': "), number, F.lit("}]")))


def cell_value(cell: Column | str, metric: str = RESULT_METRIC) -> Column:
    """The number of a metric cell (nan and inf too); null for any other text."""
    c = F.col(cell) if isinstance(cell, str) else cell
    for word, name in (("nan", "NaN"), ("-inf", "-Infinity"), ("inf", "Infinity")):
        c = F.regexp_replace(c, rf": {word}([,}}])", f": {name}$1")
    return parse_result_cell(c, metric)


def wide_results(long: DataFrame, tasks: Sequence[str], metric: str = RESULT_METRIC) -> DataFrame:
    """(train_step, one cell column per task in the given order), every step from 0 to the last one.

    ``long``: (train_step, eval_task, value), one row per cell; a missing cell is empty, a task that isn't listed is an error."""
    other = long.where(~F.col("eval_task").isin(list(tasks)) | F.col("eval_task").isNull()).select("eval_task").limit(1).collect()
    if other:
        raise ValueError(f"task {other[0][0]!r} is not in the sequence {list(tasks)}")
    steps = long.agg(F.max("train_step")).first()[0]
    every = long.sparkSession.range(0 if steps is None else steps + 1).withColumnRenamed("id", "train_step")      # as many as tasks
    cells = long.groupBy(F.col("train_step").cast("long").alias("train_step")).pivot("eval_task", list(tasks)).agg(F.first(result_cell("value", metric)))
    return every.join(cells, "train_step", "left").select("train_step", *[F.col(f"`{t}`") for t in tasks])


def write_result_csv(long: DataFrame, directory: str, sequence: str, tasks: Sequence[str], stamp: str, metric: str = RESULT_METRIC) -> str:
    """The run's CSV file; returns its path.

    The rows (as many as the sequence has tasks) are written in step order by one task, then the part file is moved to its name."""
    if not re.fullmatch(RUN_NAME, f"results_{sequence}_{stamp}"):
        raise ValueError(f"stamp {stamp!r} is not yyyyMMdd-HHmmss")
    spark = long.sparkSession
    part = shared_dir(spark, "result-part")
    wide = wide_results(long, tasks, metric).repartition(1).sortWithinPartitions("train_step").drop("train_step")
    wide.write.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}, emptyValue="", nullValue="").csv(part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target = f"{directory.rstrip('/')}/results_{sequence}_{stamp}.csv"
    fs = path(directory).getFileSystem(conf)
    fs.mkdirs(path(directory))
    source = next(f.getPath() for f in path(part).getFileSystem(conf).listStatus(path(part)) if f.getPath().getName().startswith("part-"))
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, path(target), True, True, conf):
        raise OSError(f"could not write {target}")
    return target


def read_result_csvs(spark: SparkSession, paths: str | Sequence[str], metric: str = RESULT_METRIC) -> DataFrame:
    """Result files, whatever their columns, as one long table (``LONG``).

    Files of one header are read together; every cell becomes a row with the position of its column and of its row in the file.
    ``value`` is the number of a metric cell; other texts stay in ``cell``.  The sequence and stamp come from the file's name (null
    where it is named otherwise).
    """
    out = spark.createDataFrame([], LONG)
    for header, files in headers_of(spark, paths).items():
        if not header:
            continue
        names = [f"c{i}" for i in range(len(header))]
        one = (spark.read.options(**CSV_OPTIONS).schema(", ".join(f"{n} string" for n in names)).csv(files)
               .withColumns({"file_name": F.col("_metadata.file_name"), "__path": F.col("_metadata.file_path")}))
        rows = with_row_index(one, "__path")
        cells = rows.select("file_name", F.col("row_idx").alias("train_step"),
                            F.posexplode(F.array(*[F.struct(F.lit(t).alias("eval_task"), F.col(n).alias("cell")) for t, n in zip(header, names)])).alias("eval_pos", "x"))
        stem = file_stem("file_name")
        known = stem.rlike(RUN_NAME)
        out = out.unionByName(cells.select(
            "file_name", F.when(known, F.regexp_extract(stem, RUN_NAME, 1)).alias("sequence"), F.when(known, F.regexp_extract(stem, RUN_NAME, 2)).alias("stamp"),
            "train_step", "eval_pos", "x.eval_task", "x.cell", cell_value("x.cell", metric).alias("value")))
    return out
