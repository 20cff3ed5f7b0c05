"""A label dictionary that grows as new labels arrive (ST1).

Batch form: known labels keep their id, new labels get `max_id + rank` in label
order.  Stream form: a file source feeds ``foreachBatch``; each micro-batch, of any number of files, writes
a delta with its new labels only, under its batch id, with the next ids.  After every ``COMPACT`` batches
the dictionary is written as a base; readers take the newest base and the deltas after it.  So a batch writes as many rows as it
has new labels, and a reader lists at most ``2 * COMPACT`` deltas.

A delta or a base counts once its success marker is there.  A replayed batch (same id after a restart) that has its
delta, or lies below a base, changes nothing; a half-written one is written again with the same ids: recovery
after a lost executor or driver gives the same dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from curata.session import folders_in, path_exists, remove_folder

DICT_SCHEMA = "label_id int, label string"
COMPACT = 16        # batches between two bases


def grow_dictionary(current: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Append the labels not yet known; ids continue after the current maximum."""
    return current.select("label_id", "label").unionByName(new_labels(current, labels, label_col))


def new_labels(current: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(label_id, label) of the labels not yet known.

    The rank window runs over the distinct new labels of one batch only.
    """
    fresh = (labels.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
             .join(current.select("label"), "label", "left_anti"))
    base = current.agg(F.coalesce(F.max("label_id"), F.lit(-1))).scalar()
    return fresh.select((F.row_number().over(Window.orderBy("label")) + base).cast("int").alias("label_id"), "label")


def _written(spark: SparkSession, store: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``{store}/{kind}/{number}``, ascending."""
    return sorted(int(n) for n in folders_in(spark, f"{store}/{kind}") if path_exists(spark, f"{store}/{kind}/{n}/_SUCCESS"))


def latest_dictionary(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The dictionary in `store` (optionally as it was before a batch not older than the last base)."""
    bases = [b for b in _written(spark, store, "base") if before is None or b < before]
    deltas = [d for d in _written(spark, store, "delta") if (before is None or d < before) and (not bases or d > bases[-1])]
    paths = [f"{store}/base/{b}" for b in bases[-1:]] + [f"{store}/delta/{d}" for d in deltas]
    return spark.read.schema(DICT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], DICT_SCHEMA)


def dictionary_batch_writer(store: str, labels_col: str = "labels", compact: int = COMPACT):
    """foreachBatch function: one delta per micro-batch, idempotent on replay, a base after every ``compact`` batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bases = _written(spark, store, "base")
        if bases and bases[-1] >= batch_id:
            return                                     # replayed batch: in a base
        if not path_exists(spark, f"{store}/delta/{batch_id}/_SUCCESS"):
            current = latest_dictionary(spark, store, before=batch_id)
            new_labels(current, batch.select(F.explode(labels_col).alias("label"))).write.mode("overwrite").parquet(f"{store}/delta/{batch_id}")
        if (batch_id + 1) % compact == 0:
            latest_dictionary(spark, store, before=batch_id + 1).write.mode("overwrite").parquet(f"{store}/base/{batch_id}")
            for old in [d for d in _written(spark, store, "delta") if bases and d <= bases[-1]]:     # what the base before this one holds
                remove_folder(spark, f"{store}/delta/{old}")
            for old in bases[:-1]:
                remove_folder(spark, f"{store}/base/{old}")

    return write


def run_dictionary_stream(spark: SparkSession, source: str, schema: StructType | str, store: str,
                          checkpoint: str, files_per_batch: int = 1000, labels_col: str = "labels", compact: int = COMPACT) -> StreamingQuery:
    """Process every file now in `source` (availableNow) into the dictionary in `store`."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    q = (src.writeStream.foreachBatch(dictionary_batch_writer(store, labels_col, compact))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
