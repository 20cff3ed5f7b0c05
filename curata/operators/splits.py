"""Splits, seeded order, batches, set operations and split statistics.

W3-W4, D1 (systematic; `stratify.iterative_split` is the iterative form), D2-D3, U1-U4, J5, A8-A9, O1-O2, O4.  Row order is not a Spark notion:
every order-dependent operator takes an explicit key, and "random" order is a
seeded md5 of that key (the same string hashes the same in DuckDB).  Ranks
inside groups use the two-level form of ``curata.operators.ranking`` so that a
group holding a third of the data is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators.ranking import dealt_by_ranges, hash_bucket, join_null_safe, ordered_row_number, seeded_hash, two_level_row_number
from curata.session import checkpointed

DEFAULT_SEED = 42
SPLIT_SHARES = (0.66, 0.17, 0.17)   # train, dev, test
SPLITS = ("train", "dev", "test")
STEP = 61                           # no common factor with 100: consecutive ranks spread over the shares


def seeded_order(df: DataFrame, groups: Sequence[str], key: str, seed: int = DEFAULT_SEED,
                 out: str = "rn", size_out: str | None = None) -> DataFrame:
    """Reproducible shuffled position (1-based) of each row inside its group."""
    d = df.withColumn("__h", seeded_hash(seed, key))
    return two_level_row_number(d, groups, hash_bucket(F.col("__h")),
                                [F.col("__h"), F.col(key)], out, size_out).drop("__h")


def label_strata(notes: DataFrame, key: str = "note_id", labels_col: str = "labels",
                 groups: Sequence[str] = ()) -> DataFrame:
    """Stratum of each note = its rarest label inside its group (ties: smallest label); '' when no label.

    A note is identified by its group and key: equal keys of two tasks are two notes."""
    g = list(groups)
    ex = notes.select(*g, key, F.explode(F.array_distinct(labels_col)).alias("label"))
    support = ex.groupBy(*g, "label").agg(F.count(F.lit(1)).alias("support"))
    # a label's place by (support, label): the rarest label of a note is its least place, a number, which partial aggregates
    # keep without sorting; written first, so that the join knows how small the labels of all groups are
    place = F.row_number().over(Window.partitionBy(*g).orderBy("support", "label"))
    places = checkpointed(support.select(*g, "label", place.alias("__place")), "strata")
    rare = join_null_safe(ex, places, [*g, "label"]).groupBy(*g, key).agg(F.min("__place").alias("__place"))
    rare = join_null_safe(rare, places.withColumnRenamed("label", "stratum"), [*g, "__place"]).drop("__place")
    return join_null_safe(notes, rare, [*g, key], "left").withColumn("stratum", F.coalesce("stratum", F.lit("")))


def stratified_split(notes: DataFrame, key: str = "note_id", labels_col: str = "labels",
                     seed: int = DEFAULT_SEED, shares: Sequence[float] = SPLIT_SHARES,
                     groups: Sequence[str] = ("task",)) -> DataFrame:
    """Re-split each task 66/17/17 keeping label shares.

    Re-aimed from greedy iterative stratification (sequential) to systematic sampling: stratum =
    rarest label of the note's task; the notes of a task are ranked by (stratum, seeded hash), and
    the rank r gives f = (61 r mod 100 + 0.5) / 100; train if f <= 0.66, dev if f <= 0.83, else test.
    The rank runs on across strata, so rare labels get their shares together.
    """
    needed = [key, *groups, labels_col]
    # columns that can be large (text, arrays, nested): worth keeping out of the shuffles
    wide = [f.name for f in notes.schema.fields if f.name not in needed
            and f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    base = notes.select(*[c for c in notes.columns if c not in wide]) if wide else notes
    s = label_strata(base, key, labels_col, groups).withColumn("__h", seeded_hash(seed, key))
    # the notes of a task in order of (stratum, hash); the stratum and the start of the hash are the bucket
    bucket = F.concat(F.col("stratum"), F.lit("\u0000"), F.substring("__h", 1, 2))
    ranked = two_level_row_number(s, groups, bucket, [F.col("stratum"), F.col("__h"), F.col(key)], "__r").drop("__h")
    # systematic: every hundred consecutive notes hold 66 train, 17 dev and 17 test ones, so shares hold
    # for strata of any size, single notes included
    f = F.pmod(F.col("__r") * F.lit(STEP), F.lit(100)) / 100 + 0.005
    c1 = shares[0]
    c2 = round(shares[0] + shares[1], 10)
    split = F.when(f <= c1, "train").when(f <= c2, "dev").otherwise("test")
    out = ranked.withColumn("split", split).drop("__r", "__n")
    if not wide:
        return out
    # wide notes (e.g. with text): the assignment is computed on the narrow projection
    # above and joined back once, so the wide rows are shuffled once, not twice
    g = list(groups)
    return join_null_safe(notes.select(*g, key, *wide), out, [*g, key]).select(*out.columns, *wide)


def pad_split_to_multiple(df: DataFrame, key: str = "note_id", seed: int = DEFAULT_SEED,
                          multiple: int = 8, groups: Sequence[str] = ("task",)) -> DataFrame:
    """Move k seeded train rows into dev, then into test, so both sizes divide by 8.

    Only the first 2*(multiple-1) train rows per group in seeded order can
    move, so the window is a group limit (Catalyst pre-filters it per map task).
    """
    g = list(groups)
    sizes = (df.groupBy(*g)
             .agg(F.count_if(F.col("split") == "dev").alias("n_dev"),
                  F.count_if(F.col("split") == "test").alias("n_test")))
    k1 = (F.lit(multiple) - F.col("n_dev") % multiple) % multiple
    k2 = (F.lit(multiple) - F.col("n_test") % multiple) % multiple
    sizes = sizes.select(*g, k1.alias("k1"), k2.alias("k2"))
    h = seeded_hash(seed, key)
    w = Window.partitionBy(*g).orderBy(h, F.col(key))
    cand = (df.where(F.col("split") == "train")
            .select(*g, key, F.row_number().over(w).alias("__r"))
            .where(F.col("__r") <= 2 * (multiple - 1)))
    moved = (join_null_safe(cand, sizes, g)
             .select(*g, key, F.when(F.col("__r") <= F.col("k1"), "dev")
                     .when(F.col("__r") <= F.col("k1") + F.col("k2"), "test").alias("__to"))
             .where(F.col("__to").isNotNull()))
    return (join_null_safe(df, moved, [*g, key], "left")
            .withColumn("split", F.coalesce("__to", "split")).drop("__to"))


def sample_n(df: DataFrame, n: int, key: str = "note_id", seed: int = DEFAULT_SEED) -> DataFrame:
    """D3: n rows without replacement, seeded; TakeOrdered keeps n rows per task."""
    return df.orderBy(seeded_hash(seed, key), F.col(key)).limit(n)


def batch_assign(df: DataFrame, groups: Sequence[str], key: str, batch_size: int = 8) -> DataFrame:
    """Batch number (0-based) of each row in key order inside its group; last batch short.

    The rank is two-level (a grid over the key range of the group), so a big
    group is ranked in many tasks; the result equals a single-window row number.
    """
    r = ordered_row_number(df, groups, key, out="__r")
    return r.withColumn("batch_id", F.floor((F.col("__r") - 1) / batch_size).cast("long")).drop("__r")


def head_per_group(df: DataFrame, groups: Sequence[str], key: str, n: int | str) -> DataFrame:
    """O1: first n rows (by key) of each group; 'all' keeps everything.

    The rank is two-level for every n, so no group is sorted in one task.
    """
    if n == "all":
        return df
    return ordered_row_number(df, groups, key, out="__r").where(F.col("__r") <= int(n)).drop("__r")


def head_per_split(df: DataFrame, caps: DataFrame, key: str, groups: Sequence[str] = ("task", "split")
                   ) -> DataFrame:
    """O2: first `size` rows of each (task, split), size from A4 per split; a null size keeps all.

    The rows are dealt once by ranges of (task, split, key).  The rows of each frame in each range and the caps say up to
    which row a range is kept: one row per range and frame that it holds, so a frame that is cut leaves few ranges to read.
    """
    rows = dealt_by_ranges(df, groups, [F.asc(key)], "__at").withColumn("__range", F.shiftright("__at", 33))
    counts = rows.groupBy(*groups, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ends = join_null_safe(counts, caps.select("split", "size"), ["split"], "left").where(F.col("size").isNull() | (F.col("__off") < F.col("size")))
    ends = ends.select(*groups, "__range", (F.col("__first") + F.coalesce(F.col("size") - F.col("__off"), "__n")).alias("__end"))
    return join_null_safe(rows, F.broadcast(ends), [*groups, "__range"]).where(F.col("__at") < F.col("__end")).drop("__at", "__range", "__end")


def split_shares(df: DataFrame, groups: Sequence[str] = ("task",)) -> DataFrame:
    """Rows and share of each split of a task."""
    c = df.groupBy(*groups, "split").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def distinct_text_count(df: DataFrame, groups: Sequence[str] = ("task",)) -> DataFrame:
    """Rows and distinct texts; texts are hashed (sha-256) before the shuffle."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.countDistinct(F.sha2("text", 256)).alias("n_distinct_texts"))


def dedup_text(df: DataFrame, key: str = "note_id", groups: Sequence[str] = ("task",)) -> DataFrame:
    """One row per distinct text, the smallest key kept (deterministic keep-first).

    One read and one exchange: rows are grouped by a hash of the text, each task sends a text once per group; equal
    hashes mean equal texts, so any text of a group is the group's.
    """
    g, h = list(groups), F.sha2("text", 256)
    return df.groupBy(*g, h.alias("__h")).agg(F.any_value("text").alias("text"), F.min(key).alias(key)).drop("__h")


def union_splits(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def subjects_intersect(df: DataFrame, a: str, b: str, subject: str = "subject_id") -> DataFrame:
    """Subjects present in both splits a and b."""
    return (df.where(F.col("split") == a).select(subject)
            .intersect(df.where(F.col("split") == b).select(subject)))


def rows_except(df: DataFrame, moved: DataFrame, key: str | Sequence[str] = "note_id") -> DataFrame:
    """U4: rows of df whose key (one column or several) is not in `moved`."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(moved.select(*keys), keys, "left_anti")


def split_leakage(df: DataFrame, subject: str = "subject_id", groups: Sequence[str] = (),
                  splits: Sequence[str] = SPLITS) -> DataFrame:
    """For each pair of splits, the number of subjects that occur in both.

    One aggregation per subject (the set of its splits has at most 3 entries),
    then conditional counts per pair: no self-join, no pairs of rows.
    """
    g = list(groups)
    sets = df.groupBy(*g, subject).agg(F.collect_set("split").alias("__s"))
    pairs = [(a, b) for i, a in enumerate(sorted(splits)) for b in sorted(splits)[i + 1:]]
    aggs = [F.count_if(F.array_contains("__s", a) & F.array_contains("__s", b)).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)]
    wide = sets.groupBy(*g).agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                                         F.col(f"p{i}").alias("shared_subjects"))
                                for i, (a, b) in enumerate(pairs)])).alias("x")
    return wide.select(*g, stack).select(*g, "x.*")


def rank_groups_by_size(df: DataFrame, group: str = "task") -> DataFrame:
    """Groups by row count, descending, with rank (global window over groups only)."""
    c = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), group)).cast("int"))
