"""File sources and sinks.

Notes arrive as CSV files, one per (task, split), with quoted multi-line text
and a Python list literal of labels per row.  Spark reads a multi-line CSV file in one
task; ``csv_blocks`` reads a large one in many.  Ingest once into partitioned Parquet
(``write_splits``) and run everything else on Parquet.  No schema is
inferred; file names become columns through ``_metadata`` (one read of the
whole directory, never a driver loop over files).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from curata.functions.text import file_stem, key_split, key_task, parse_label_list, render_label_list
from curata.operators.labels import normalise_columns

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
TEXT_SOURCES = ("text", "TEXT", "notes")


def headers_of(spark: SparkSession, paths: str | Sequence[str], encoded: bool = False) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it (the driver gets the list of files, as any scan does); ``encoded``: as file metadata names them."""
    lines = (spark.read.text(paths if isinstance(paths, str) else list(paths))
             .where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at")))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).orderBy("path").collect():
        found.setdefault(tuple(next(csv.reader([r["header"]]), ())), []).append(r["path"] if encoded else unquote(r["path"]))
    return found


def _csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files by column name: files of equal header are read together, then united by name."""
    r = spark.read.options(**CSV_OPTIONS)
    whole = r.csv(paths if isinstance(paths, str) else list(paths))
    groups = headers_of(spark, paths)
    if len(groups) <= 1:
        return whole.withColumns({"file_name": F.col("_metadata.file_name"), "__path": F.col("_metadata.file_path")})
    if isinstance(paths, str):
        r = r.option("basePath", paths)            # keeps the partition columns
    frames = []
    for header, files in groups.items():
        names = StructType([StructField(n, StringType()) for n in header])
        one = r.schema(names).csv(files).withColumns({"file_name": F.col("_metadata.file_name"), "__path": F.col("_metadata.file_path")})
        sources = [c for c in TEXT_SOURCES if c in header]
        frames.append(one.withColumnRenamed(sources[0], "text") if len(sources) == 1 else one)
    out = frames[0]
    for one in frames[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def with_row_index(df: DataFrame, by: str = "file_name") -> DataFrame:
    """`row_idx` = position of the row inside its file (0-based).

    A multi-line CSV file cannot be split, so all its rows are read, in file
    order, by one task, and their increasing ids are consecutive.  The index is
    the id minus the smallest id of the file: a per-file minimum (a partial
    aggregate, one row per file) joined back, with no shuffle or sort of the rows
    themselves, so a file holding a third of the corpus costs no more than reading it.
    """
    d = df.withColumn("__mid", F.monotonically_increasing_id())
    first = d.groupBy(by).agg(F.min("__mid").alias("__first"))
    return (d.join(first, by)
            .withColumn("row_idx", (F.col("__mid") - F.col("__first")).cast("long"))
            .drop("__mid", "__first"))


def read_notes_csv(spark: SparkSession, paths: str | Sequence[str], labels_element: str = "string", by_blocks: bool = False) -> DataFrame:
    """Note CSVs -> (file_name, row_idx, text, labels array, other columns).

    Text column unified from `text` / `TEXT` / `notes`; labels parsed from the
    list literal (malformed -> null, never evaluated as code; `rejected_notes` lists those
    rows).  Files may order and name their columns differently; a row is known by
    the path of its file and its index there.  ``by_blocks``: large plain files are cut at record ends and read by
    many tasks (see ``csv_blocks``); else one task reads a file.
    """
    if by_blocks:
        from curata.sources.csv_blocks import read_csv_by_blocks

        raw = read_csv_by_blocks(spark, paths)
    else:
        raw = with_row_index(_csv(spark, paths), "__path")
    df = normalise_columns(raw)
    if "labels" in df.columns:
        df = df.withColumn("labels", parse_label_list("labels", labels_element))
    return df.drop("__path")


def rejected_notes(spark: SparkSession, paths: str | Sequence[str], labels_element: str = "string") -> DataFrame:
    """Rows whose label cell is not a list literal: (file_name, row_idx, labels as written)."""
    df = with_row_index(_csv(spark, paths), "__path")
    bad = F.col("labels").isNotNull() & parse_label_list("labels", labels_element).isNull()
    return df.where(bad).select("file_name", "row_idx", "labels")


def write_notes_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with `labels` rendered as a Python list literal (the reference's cell format)."""
    out = df
    if "labels" in df.columns:
        numeric = df.schema["labels"].dataType.simpleString() != "array<string>"
        lit = (F.concat(F.lit("["), F.array_join(F.col("labels").cast("array<string>"), ", "), F.lit("]"))
               if numeric else render_label_list("labels"))
        out = df.withColumn("labels", lit)
    w = out.write.mode("overwrite").options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"})
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def file_key_columns(df: DataFrame, name_col: str = "file_name") -> DataFrame:
    """S2 key rule: key = name without its last extension; task = all but the last '_'
    token; split = last token."""
    stem = file_stem(name_col)
    return df.withColumn("key", stem).withColumn("task", key_task(stem)).withColumn("split", key_split(stem))


def scan_task_dir(spark: SparkSession, directory: str) -> DataFrame:
    """Every note CSV below `directory`, keyed by file name -> task, split.

    Files may be plain (`x_fold_1_train.csv`) or Spark-written folders
    partitioned by `file_key=<name>.csv`; the partition value then is the name.
    """
    df = read_notes_csv(spark, directory)
    name = F.col("file_key") if "file_key" in df.columns else F.col("file_name")
    return file_key_columns(df.withColumn("__name", name), "__name").drop("__name")


def scan_stratified_dir(spark: SparkSession, directory: str, tasks: Sequence[str]) -> DataFrame:
    """S3: pre-split files with multi-hot label lists; key = `tok0_tok1_lastTok` of the
    stem before the first dot.  Every requested task must match some file; files
    are kept in request order (`task_rank`) and each file once.  No request keeps all files."""
    df = read_notes_csv(spark, directory, labels_element="double")
    name = F.col("file_key") if "file_key" in df.columns else F.col("file_name")
    stem = F.split(name, "\\.").getItem(0)
    toks = F.split(stem, "_")
    key = F.concat_ws("_", toks.getItem(0), toks.getItem(1), F.element_at(toks, -1))
    df = df.withColumn("key", key).withColumn("split", F.element_at(toks, -1))
    if not tasks:
        return df.withColumn("task_rank", F.lit(None).cast("int"))
    names = [r[0] for r in df.select(name).distinct().collect()]          # the file list, not the rows
    missing = [t for t in tasks if not any(t in n for n in names)]
    if missing:
        raise ValueError(f"{missing} not found in the data directory")
    rank = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tasks))):
        rank = F.when(name.contains(t), F.lit(i)).otherwise(rank)
    return df.withColumn("task_rank", rank).where(F.col("task_rank").isNotNull())


def read_label_universe(spark: SparkSession, path: str, key: str = "all_D_codes") -> DataFrame:
    """Label universe from a JSON object holding an array under `key`."""
    j = spark.read.option("multiLine", "true").json(path)
    return j.select(F.explode(key).alias("label")).distinct()


def write_label_universe(labels: DataFrame, path: str, key: str = "all_D_codes") -> None:
    """Sink for S4: one JSON object with the sorted label array (size of the label set)."""
    (labels.agg(F.sort_array(F.collect_set("label")).alias(key))
     .coalesce(1).write.mode("overwrite").json(path))


def read_three_splits(spark: SparkSession, pattern: str, splits: Sequence[str] = ("train", "dev", "test"),
                      optional: Sequence[str] = ("test",)) -> DataFrame:
    """train/dev/test by path pattern (`{split}` placeholder); an optional split that
    is missing reads as empty; notes without labels are dropped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    frames = []
    for s in splits:
        p = pattern.format(split=s)
        hp = jvm.org.apache.hadoop.fs.Path(p)
        exists = hp.getFileSystem(conf).exists(hp)
        if not exists:
            if s in optional:
                continue
            raise FileNotFoundError(p)
        frames.append(read_notes_csv(spark, p).withColumn("split", F.lit(s)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.where(F.size("labels") > 0)


def read_code_list(spark: SparkSession, path: str, column: str = "ccs") -> DataFrame:
    """One-column code list for zero-shot masking."""
    return spark.read.option("header", "true").csv(path).select(F.col(column).alias(column)).distinct()


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per (task, split); Parquet by default, CSV with list-literal labels on request."""
    if fmt == "parquet":
        df.write.mode("overwrite").partitionBy("task", "split").parquet(path)
    else:
        write_notes_csv(df, path, ("task", "split"))


def write_result_matrix(long: DataFrame, path: str, sequence: str, ts_col: str | None = None) -> str:
    """The long result table with its run id `results_{sequence}_{yyyyMMdd-HHmmss}`."""
    stamp = F.date_format(F.col(ts_col) if ts_col else F.current_timestamp(), "yyyyMMdd-HHmmss")
    out = long.withColumn("run", F.concat(F.lit(f"results_{sequence}_"), stamp))
    if ts_col:
        out = out.drop(ts_col)
    out.write.mode("append").partitionBy("run").parquet(path)
    return path


def read_result_dir(spark: SparkSession, path: str) -> DataFrame:
    """All result tables below `path`, with the file each row came from."""
    return spark.read.parquet(path).withColumn("file_name", F.col("_metadata.file_name"))
