"""Iterative stratification of multi-label notes.

Every label of a task has a quota per split: its share of the label's notes.  The labels of a task
take turns, the rarest first; the turn of a label assigns the notes of which it is the rarest label, so after it
all its notes are assigned.  The turn gets whole numbers per split that meet what is left of the label's quotas (largest
remainder).  Which note goes where follows from its other labels: the notes whose other labels miss train most go to
train, of the rest those that want dev more than test go to dev.  Then the quotas are
refreshed by an aggregation over what was assigned.  Tasks take their turns side by side, so there are as many rounds as the
largest label set has labels, and one for the notes without labels, which level the sizes of the splits.

The driver holds the quota table: labels x splits, bounded by the label sets, never by the notes.  The
notes lie in one folder per round.  The notes of one task in one round are ordered by one task of Spark while
they are at most ``SMALL``; more are dealt by ranges of the same order over many tasks, all large tasks of a round together: the driver
gets the rows of each range and says at which row of which range a split ends.  No round needs Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators.keys import note_key
from curata.operators.ranking import RANGES, dealt_by_ranges, join_null_safe, seeded_hash
from curata.operators.splits import DEFAULT_SEED, SPLIT_SHARES, SPLITS
from curata.session import checkpointed, shared_dir

SMALL = 200_000     # notes of one task and round that one Spark task may order


class Quotas:
    """Of one task: the open notes and the unmet quotas of every label, by the label's turn; the last place is all notes."""

    def __init__(self, support: Sequence[int], n_notes: int, shares: Sequence[float]):
        self.shares = np.array(shares)
        self.open = np.array([*support, n_notes], float)
        self.unmet = self.open[:, None] * self.shares

    def turn(self, label: int, n: int) -> list[int]:
        """How many of the n notes of a label's turn each split gets: whole numbers next to the unmet quotas, which they make up for."""
        want = np.maximum(self.unmet[label], 0)
        want = want * (n / want.sum()) if want.sum() else self.shares * n
        got = np.floor(want + 1e-9).astype(int)
        for k in sorted(range(len(want)), key=lambda k: (round(got[k] - want[k], 9), k))[: n - got.sum()]:
            got[k] += 1
        return got.tolist()

    def pull(self) -> np.ndarray:
        """Per label and split: the unmet share of its open notes, over what is due."""
        return np.round(self.unmet / np.maximum(self.open, 1)[:, None] - self.shares, 9)

    def refresh(self, label: int, split: int, n: int) -> None:
        self.open[label] -= n
        self.unmet[label, split] -= n


def _pulled(labels: Column, *pulls: Column) -> Column:
    """The sum of the labels' pulls, first by first as NumPy adds them; rounded like the pulls of one task."""
    def summed(pull: Column) -> Column:
        return F.aggregate(labels, F.lit(0.0), lambda total, x: total + F.get(pull, x))

    total = summed(pulls[0]) if len(pulls) == 1 else summed(pulls[0]) - summed(pulls[1])
    return F.rint(total * 1e7) / 1e7 + F.lit(0.0)


def _plan(rows: DataFrame, g: Sequence[str], turns: dict[tuple, tuple[int, list[int], np.ndarray]], small: bool) -> DataFrame:
    """The notes of some tasks with what their turn says: the pull of a note's other labels to train, and to dev rather than
    test, and how many notes go to train (``__first``) and dev (``__second``)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*g).schema) + ", "
    table = [(*task, label, sizes[0], sizes[1], *(pull[:, k].tolist() for k in range(3))) for task, (label, sizes, pull) in turns.items()]
    said = rows.sparkSession.createDataFrame(table, f"{kinds if g else ''}__label int, __first long, __second long, __train array<double>, __dev array<double>, __test array<double>")
    others = F.filter("__labels", lambda x: x != F.col("__label"))
    return join_null_safe(rows, F.broadcast(said), g).withColumn("__others", others).select(
        *rows.columns, *(["__first", "__second"] if small else []), _pulled(F.col("__others"), F.col("__train")).alias("__p"),
        _pulled(F.col("__others"), F.col("__dev"), F.col("__test")).alias("__q"))


def _in_one_task(rows: DataFrame, g: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The split number of each note: the strongest pulls to train first, of the rest those to dev; ties by the seeded hash."""
    first = Window.partitionBy(*g).orderBy(F.desc("__p"), "__h")
    second = Window.partitionBy(*g, "__in").orderBy(F.desc("__q"), "__h")
    rows = rows.withColumn("__in", F.row_number().over(first) <= F.col("__first"))
    return rows.select(*kept, F.when(F.col("__in"), 0).when(F.row_number().over(second) <= F.col("__second"), 1).otherwise(2).alias("__split"))


def _within(rows: DataFrame, g: Sequence[str], sizes: dict[tuple, int]) -> DataFrame:
    """``__in`` for rows dealt by ranges: whether a row is one of the first of its task, as many as ``sizes`` says."""
    counts = rows.groupBy(*g, F.shiftright("__at", 33).alias("__range")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    ends, left = {task: -1 for task in sizes}, dict(sizes)
    for r in sorted(counts.collect(), key=lambda r: r["__range"]):                     # tasks and ranges
        task = tuple(r[c] for c in g)
        if left[task] > 0:
            ends[task] = r["first"] + min(left[task], r["n"]) - 1
            left[task] -= r["n"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*g).schema) + ", "
    table = rows.sparkSession.createDataFrame([(*task, end) for task, end in ends.items()], f"{kinds if g else ''}__end long")
    return join_null_safe(rows, F.broadcast(table), g).withColumn("__in", F.col("__at") <= F.col("__end")).drop("__at", "__end")


def _by_ranges(rows: DataFrame, g: Sequence[str], turns: dict[tuple, tuple], kept: Sequence[str], ranges: int) -> DataFrame:
    """The same assignment for tasks too large for one task of Spark: two orders by ranges, the second of what the first left."""
    dealt = _within(dealt_by_ranges(rows, g, [F.desc("__p"), F.asc("__h")], "__at", ranges), g, {t: sizes[0] for t, (_, sizes, _) in turns.items()})
    rest = dealt_by_ranges(dealt.where(~F.col("__in")).drop("__in"), g, [F.desc("__q"), F.asc("__h")], "__at", ranges)
    rest = _within(rest, g, {t: sizes[1] for t, (_, sizes, _) in turns.items()})
    return dealt.where("__in").select(*kept, F.lit(0).alias("__split")).unionByName(rest.select(*kept, F.when(F.col("__in"), 1).otherwise(2).alias("__split")))


def iterative_split(notes: DataFrame, key: str = "note_id", labels_col: str = "labels", seed: int = DEFAULT_SEED, shares: Sequence[float] = SPLIT_SHARES,
                    groups: Sequence[str] = ("task",), small: int = SMALL) -> DataFrame:
    """Notes with `split` (train, dev, test), every label's shares met in each task as far as whole notes allow.

    A note is its task and its key; null tasks are a task; rows that repeat a note get its split; null and repeated labels don't count; notes without labels
    level the sizes.  The same notes and seed give the same split, however they are partitioned.
    """
    g = list(groups)
    own = note_key(notes, [*g, key])
    labels = F.array_compact(F.array_distinct(F.coalesce(labels_col, F.array().cast("array<string>"))))
    narrow = checkpointed(notes.select(*own, labels.alias("__labels")).dropDuplicates(own), "strat-notes")
    long = narrow.select(*own, F.explode("__labels").alias("label"))
    support = long.groupBy(*g, "label").agg(F.count(F.lit(1)).alias("n"))
    turns = checkpointed(support.withColumn("__turn", (F.row_number().over(Window.partitionBy(*g).orderBy("n", "label")) - 1).cast("int")), "strat-turns")
    sizes = {tuple(r[c] for c in g): r["n"] for r in narrow.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).collect()}      # tasks
    counts: dict[tuple, list[int]] = {t: [] for t in sizes}
    for r in turns.orderBy("__turn").collect():                                                                          # labels of all tasks
        counts[tuple(r[c] for c in g)].append(r["n"])
    quotas = {t: Quotas(counts[t], n, shares) for t, n in sizes.items()}

    every = narrow.select(*own, F.explode_outer("__labels").alias("label"))
    ids = join_null_safe(every, turns.drop("n"), [*g, "label"], "left").groupBy(*own).agg(F.array_sort(F.collect_list("__turn")).alias("__labels"))
    last = max((len(c) for c in counts.values()), default=0)
    rows = checkpointed(ids.select(
        *own, "__labels", F.coalesce(F.get("__labels", F.lit(0)), F.lit(last)).alias("__turn"),
        F.concat(seeded_hash(seed, *own), F.lit(":"), F.col(key).cast("string")).alias("__h")), "strat-rows")
    path = shared_dir(notes.sparkSession, "strat-rounds")
    rows.repartitionByRange("__turn", "__h").write.partitionBy("__turn").parquet(f"{path}/in")
    todo = rows.groupBy("__turn", *g).agg(F.count(F.lit(1)).alias("n")).collect()                                          # labels of all tasks
    spark, schema = notes.sparkSession, rows.drop("__turn").schema
    kept = [*own, "__labels"]
    done = []
    for turn in sorted({r["__turn"] for r in todo}):
        n_here = {tuple(r[c] for c in g): r["n"] for r in todo if r["__turn"] == turn}
        plan = {t: (turn, quotas[t].turn(turn if turn < last else -1, n), quotas[t].pull()) for t, n in n_here.items()}
        here = spark.read.schema(schema).parquet(f"{path}/in/__turn={turn}")
        few = {t: plan[t] for t in plan if n_here[t] <= small}
        many = {t: plan[t] for t in plan if t not in few}

        parts = [_in_one_task(_plan(here, g, few, True), g, kept)] if few else []
        if many:
            parts.append(_by_ranges(_plan(here, g, many, False), g, many, kept, RANGES))
        reduce(DataFrame.unionByName, parts).write.parquet(f"{path}/out/turn={turn}")
        done.append(f"{path}/out/turn={turn}")
        given = spark.read.parquet(done[-1]).select(*g, "__split", F.explode(F.concat("__labels", F.array(F.lit(-1)))).alias("label"))
        for r in given.groupBy(*g, "__split", "label").agg(F.count(F.lit(1)).alias("n")).collect():      # labels x splits
            quotas[tuple(r[c] for c in g)].refresh(r["label"], r["__split"], r["n"])
    if not done:
        return notes.withColumn("split", F.lit(None).cast("string"))
    names = F.array(*[F.lit(s) for s in SPLITS])
    split = spark.read.parquet(*done).select(*own, F.get(names, F.col("__split")).alias("split"))
    return join_null_safe(notes, split, own, "left")


def label_quotas(split: DataFrame, key: str = "note_id", labels_col: str = "labels", shares: Sequence[float] = SPLIT_SHARES, groups: Sequence[str] = ("task",)) -> DataFrame:
    """(groups, label, split, positives, quota, assigned, n_notes): how far each label's notes in a split are from its share."""
    g = list(groups)
    known = F.array_compact(F.array_distinct(F.coalesce(labels_col, F.array())))
    long = split.select(*g, "split", F.explode(F.concat(known, F.array(F.lit(None)))).alias("label"))
    counted = long.groupBy(*g, "label").agg(F.count(F.lit(1)).alias("positives"), F.count_if(F.col("split").isNotNull()).alias("n_notes"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    # the null label stands for every note once
    got = counted.withColumn("n_notes", F.max(F.when(F.col("label").isNull(), F.col("n_notes"))).over(Window.partitionBy(*g))).where(F.col("label").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), (F.col("positives") * share).alias("quota"), F.col(s).alias("assigned")) for s, share in zip(SPLITS, shares)])).alias("x")
    return got.select(*g, "label", "positives", "n_notes", each).select(*g, "label", "x.split", "positives", "x.quota", "x.assigned", "n_notes")
