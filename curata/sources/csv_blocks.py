"""CSV files with quoted line breaks, read by blocks: one large file feeds many tasks.

A line break ends a record only where the quotes before it are even, which a block in the middle of a file can't know by itself.
A first scan takes from every block the parity of its quotes and how many records start in it, for an even and for an odd
beginning.  Running sums over the blocks of a file give the parity and the record number that each block begins with.  A
second scan cuts the records; the few that cross blocks leave as fragments and are joined.

The input is plain CSV: a field with a quote, comma or line break is quoted and its quotes are doubled (as pandas and Spark write it).
A quote inside an unquoted field breaks the count; such files need the whole-file reader.  Blank lines between records are skipped,
line breaks inside texts stay as they are written.  The driver
keeps two numbers per block, as it keeps the list of splits of any scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.session import checkpointed
from curata.sources.files import CSV_OPTIONS, headers_of

RECORD = "path string, row_idx long, at long, whole boolean, record string"


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, at, value): the lines of every block in order; ``at`` is where the block starts."""
    text = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The rows of a batch, cut where the block changes."""
    path, at = batch.column(0), batch.column(1).to_numpy()
    names = path.to_pylist() if batch.num_rows else []
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or at[i] != at[start] or names[i] != names[start]:
            yield names[start], int(at[start]), batch.column(2).slice(start, i - start)
            start = i


def _quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per line the parity of the quotes before it (from the first line on), and whether it is blank; one more parity at the end."""
    odd = np.asarray(pc.count_substring(lines, '"')) % 2
    blank = np.asarray(pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r")))
    return np.concatenate(([0], np.cumsum(odd) % 2)), blank


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, at, lines in _runs(batch):
            parity, blank = _quotes(lines)
            # seen so far in the batch; batches of a block are added up in their order below
            rows.append((path, at, int(parity[-1]), int(((parity[:-1] == 0) & ~blank).sum()), int(((parity[:-1] == 1) & ~blank).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                                         ["path", "at", "odd", "even_starts", "odd_starts"]) if rows else batch.slice(0, 0)


def block_starts(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(path, block) -> (parity of the quotes before it, records that start before it)."""
    def whole_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[int]] = {}
        for counted in _count(batches):
            if counted.num_columns == 5:
                for path, at, odd, even_starts, odd_starts in zip(*(c.to_pylist() for c in counted.columns)):
                    own = seen.setdefault((path, at), [0, 0, 0])
                    own[1] += odd_starts if own[0] else even_starts
                    own[2] += even_starts if own[0] else odd_starts
                    own[0] ^= odd
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen]), pa.array([a for _, a in seen], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*seen.values()))],
                                             ["path", "at", "odd", "n0", "n1"])

    blocks = checkpointed(lines.mapInArrow(whole_block, "path string, at long, odd long, n0 long, n1 long"), "csv-blocks")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)        # blocks of a file
    open_ = blocks.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    starts = open_.withColumn("n", F.when(F.col("open") == 0, F.col("n0")).otherwise(F.col("n1")))
    first = starts.select("path", "at", "open", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return {(r["path"], r["at"]): (r["open"], r["first"]) for r in first.collect()}


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, row_idx, record): the text of every record, the header too, with its number in the file; ``path`` as in file metadata."""
    lines = _lines(spark, paths)
    known = spark.sparkContext.broadcast(block_starts(lines))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, held, is_whole = None, 0, [], True      # the block, the number of its open record and the lines so far

        for batch in batches:
            out: list[tuple] = []
            for path, at, lines in _runs(batch):
                if (path, at) != block:
                    if held:
                        out.append((block[0], number, block[1], False, "\n".join(held)))
                    block, (open_, first) = (path, at), known.value[path, at]
                    number, held, is_whole = first - 1, [], not open_
                else:
                    open_ = int(bool(held))
                parity, blank = _quotes(lines)
                parity ^= open_
                texts = lines.to_pylist()
                ends = np.flatnonzero(parity[1:] == 0)          # lines after which the quotes are even
                done = 0
                for end in ends.tolist():
                    if held:
                        text = "\n".join([*held, *texts[done:end + 1]])
                        out.append((path, number, at, is_whole, text.removesuffix("\r")))
                        held, is_whole = [], True
                    elif open_ and not is_whole and done == 0:   # the rest of a record that began in an earlier block
                        out.append((path, number, at, False, "\n".join(texts[:end + 1]).removesuffix("\r")))
                        is_whole = True
                    elif not (end == done and blank[done]):
                        number += 1
                        out.append((path, number, at, True, "\n".join(texts[done:end + 1]).removesuffix("\r")))
                    done = end + 1
                if done < len(texts):
                    if not held and not (open_ and not is_whole and done == 0):
                        number += 1
                        is_whole = True
                    held += texts[done:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))],
                                                 ["path", "row_idx", "at", "whole", "record"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block[0]]), pa.array([number], pa.int64()), pa.array([block[1]], pa.int64()), pa.array([False]), pa.array(["\n".join(held)])],
                                             ["path", "row_idx", "at", "whole", "record"])

    found = checkpointed(lines.mapInArrow(cut, RECORD), "csv-records")
    crossing = found.where(~F.col("whole")).groupBy("path", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return found.where("whole").select("path", "row_idx", "record").unionByName(crossing)


def read_csv_by_blocks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The columns of the files' headers (strings), file_name, __path, row_idx (0-based, after the header).

    Files of one header are parsed together and united by name with the others."""
    records = read_records(spark, paths).where(F.col("row_idx") > 0)
    out = None
    for header, files in headers_of(spark, paths, encoded=True).items():
        if not header:
            continue
        names = [f"c{i}" for i in range(len(header))]
        own = records.where(F.col("path").isin(files))
        row = F.from_csv("record", ", ".join(f"{n} string" for n in names), {k: v for k, v in CSV_OPTIONS.items() if k != "header"})
        one = own.select(row.alias("x"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("__path"), (F.col("row_idx") - 1).alias("row_idx"))
        one = one.select(*[F.col(f"x.{n}").alias(h) for n, h in zip(names, header)], "file_name", "__path", "row_idx")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV file with a header in {paths}")
    return out
