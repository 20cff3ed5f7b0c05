"""Label dictionary, label ids, multi-hot vectors and label coverage.

Labels are kept long and sparse: the canonical form is ``note_labels(note_id,
label_id)``.  Dense vectors are built only at the edge (``multi_hot``).
Lookup tables (dictionary, code lists) are joined without a broadcast hint:
AQE measures the materialised side and broadcasts it only when it is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the join stays a
shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.operators.keys import note_key
from curata.operators.ranking import join_null_safe, two_level_row_number


def label_universe(notes: DataFrame, labels_col: str = "labels") -> DataFrame:
    """A1: distinct labels over all notes (before any task filter)."""
    return (notes.select(F.explode(labels_col).alias("label"))
            .where(F.col("label").isNotNull())
            .distinct())


def label_dictionary(notes: DataFrame, labels_col: str = "labels", two_level: bool = False) -> DataFrame:
    """A2: dense ids from 0 in sorted label order.

    The default window is global, but it runs on the distinct label set only
    (the label vocabulary, hundreds to tens of thousands of rows), never on
    notes.  `two_level=True` ranks a label set too large for one task by
    buckets of its first two characters (monotone in the binary string order).
    """
    labels = label_universe(notes, labels_col)
    if two_level:
        r = two_level_row_number(labels, [], F.substring("label", 1, 2), [F.col("label")], "__rn")
        return r.select((F.col("__rn") - 1).cast("int").alias("label_id"), "label")
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_id"),
                         "label")


def labels_union(a: DataFrame, b: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Union of the label sets of two frames."""
    return label_universe(a, labels_col).union(label_universe(b, labels_col)).distinct()


def num_labels(dictionary: DataFrame) -> Column:
    """A5: vector length, as a scalar subquery (evaluated once, no driver loop)."""
    return dictionary.agg(F.count(F.lit(1)).cast("int")).scalar()


def note_labels(notes: DataFrame, dictionary: DataFrame, key: str | Sequence[str] | None = None,
                labels_col: str = "labels", strict: bool = True) -> DataFrame:
    """J1/J2 long form: (key, pos, label_id) for every label of every note (key: task and id by default).

    strict: an unknown label fails the query (raise_error); lenient: dropped.
    """
    keys = note_key(notes, key)
    j = notes.select(*keys, F.posexplode(labels_col).alias("pos", "label")).join(dictionary, "label", "left" if strict else "inner")
    if strict:
        j = j.withColumn("label_id", _known_id(F.col("label_id").isNull()))
    return j.select(*keys, "pos", "label_id")


def _known_id(unknown: Column) -> Column:
    """The label id; a row that is ``unknown`` fails the query."""
    return F.when(unknown, F.raise_error(F.concat(F.lit("unknown label: "), F.col("label")))).otherwise(F.col("label_id")).cast("int")


def labels_to_ids(notes: DataFrame, dictionary: DataFrame, key: str | Sequence[str] | None = None,
                  labels_col: str = "labels", strict: bool = True,
                  carry: Sequence[str] | None = None) -> DataFrame:
    """Add `label_ids` (array<int>, in the order of the label list).

    A note is its task and its id (null tasks count), unless ``key`` says otherwise.  Notes whose labels are
    all unknown (lenient) keep an empty array.  With `carry` (narrow columns fixed per note) the notes are read once:
    labels are exploded with empty lists kept, looked up, and gathered back per
    note with the carried columns; the result has key + carry + label_ids.
    Without it, the ids are joined back to all columns of `notes`.
    """
    keys = note_key(notes, key)
    ordered = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda s: s["label_id"]).alias("label_ids")
    if carry is not None:
        by = list(dict.fromkeys([*keys, *carry]))
        ex = notes.select(*by, F.posexplode_outer(labels_col).alias("pos", "label"))
        j = ex.join(dictionary, "label", "left")
        if strict:
            j = j.withColumn("label_id", _known_id(F.col("label").isNotNull() & F.col("label_id").isNull()))
        return j.groupBy(*by).agg(ordered(F.when(F.col("label_id").isNotNull(), F.struct("pos", "label_id"))))
    ids = note_labels(notes, dictionary, keys, labels_col, strict).groupBy(*keys).agg(ordered(F.struct("pos", "label_id")))
    return (join_null_safe(notes, ids, keys, "left")
            .withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<int>"))))


def multi_hot(notes_with_ids: DataFrame, n_labels: Column | int, ids_col: str = "label_ids",
              out: str = "labels_ohe") -> DataFrame:
    """A3: 0/1 double vector of length L; repeated labels collapse to 1."""
    # the length is materialised as a column first: a scalar subquery may not sit
    # inside a higher-order function
    d = notes_with_ids.withColumn("__L", F.lit(n_labels) if isinstance(n_labels, int) else n_labels)
    n = F.col("__L")
    ids = F.col(ids_col)
    vec = F.transform(F.sequence(F.lit(0), n - 1),
                      lambda i: F.when(F.array_contains(ids, i), 1.0).otherwise(0.0))
    return d.withColumn(out, F.when(n > 0, vec).otherwise(F.array().cast("array<double>"))).drop("__L")


def ids_to_labels(df: DataFrame, dictionary: DataFrame, key: str | Sequence[str] | None = None,
                  ohe_col: str = "labels_ohe") -> DataFrame:
    """Multi-hot -> label names where the value is 1, in id order; a note is its task and its id."""
    keys = note_key(df, key)
    hot = (df.select(*keys, F.posexplode(ohe_col).alias("label_id", "v"))
           .where(F.col("v") == 1.0)
           .join(dictionary, "label_id"))
    names = (hot.groupBy(*keys)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("label_id", "label"))),
                              lambda s: s["label"]).alias("decoded")))
    return (join_null_safe(df.select(*keys), names, keys, "left")
            .withColumn("decoded", F.coalesce("decoded", F.array().cast("array<string>"))))


def scorable_labels(cells: DataFrame, group: Sequence[str] = ("task",),
                    label: str = "label_id", y: str = "y_true", selected: Sequence[int] | None = None) -> DataFrame:
    """Labels with both classes present: 0 < positives < rows.

    Output (group..., label, positives, n, position) where position is the
    0-based index of the label among the scorable labels of its group.  With ``selected`` (label ids) also `chosen`: whether the label is
    one of them; the positions of chosen rows are the intersection's places in the scored matrix.
    """
    g = list(group)
    agg = cells.groupBy(*g, label).agg(F.sum(y).cast("long").alias("positives"), F.count(F.lit(1)).alias("n"))
    return _positions(agg, g, label, selected)


def _positions(counts: DataFrame, g: list[str], label: str, selected: Sequence[int] | None) -> DataFrame:
    """The scorable labels with their positions; the window runs over them only (bounded by the label set)."""
    pos = (F.row_number().over(Window.partitionBy(*g).orderBy(label)) - 1).cast("int")
    out = counts.where((F.col("positives") > 0) & (F.col("positives") < F.col("n"))).withColumn("position", pos)
    return out if selected is None else out.withColumn("chosen", F.col(label).isin(list(selected)))


def unused_labels(note_label_groups: DataFrame, dictionary: DataFrame, groups: Sequence[str],
                  group_values: Sequence[tuple], label: str = "label_id") -> DataFrame:
    """Labels that never occur in a (task, split) group, and the used flag.

    No cross product of labels x groups: counts are pivoted to one column per
    group (the group list is a parameter, e.g. tasks x {train, dev, test}),
    left-joined to the dictionary, and unpivoted.  Rows: one per (label, group).
    """
    gkey = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in groups])
    names = ["\u0001".join(str(x) for x in v) for v in group_values]
    counts = (note_label_groups.select(label, gkey.alias("__g"))
              .groupBy(label).pivot("__g", names).agg(F.count(F.lit(1))))
    cols = [f"g{i}" for i in range(len(names))]
    wide = dictionary.join(counts.toDF(label, *cols), label, "left")
    stacked = wide.unpivot([label, "label"], cols, "__gi", "n")
    idx = F.regexp_extract("__gi", r"^g(\d+)$", 1).cast("int")
    out = stacked.withColumn("__i", idx)
    for j, c in enumerate(groups):
        vals = F.array(*[F.lit(v[j]) for v in group_values])
        out = out.withColumn(c, F.element_at(vals, F.col("__i") + 1))
    return out.select(*groups, label, "label",
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      (F.coalesce("n", F.lit(0)) > 0).alias("used"))


def split_size_cap(notes: DataFrame, caps: dict[str, int | str]) -> DataFrame:
    """A4: per split, min(configured cap, smallest (task, split) frame); 'all' or no entry: null, no cap."""
    sizes = notes.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"))
    cap_map = F.create_map(*[x for k, v in caps.items()
                             for x in (F.lit(k), F.lit(None if v == "all" else int(v)).cast("long"))])
    agg = sizes.groupBy("split").agg(F.min("n").alias("smallest"))
    cap = F.element_at(cap_map, F.col("split"))
    return agg.select("split", "smallest",
                      F.when(cap.isNotNull(), F.least(cap, F.col("smallest"))).cast("long").alias("size"))


def mask_zero_shot(note_labels_split: DataFrame, codes: DataFrame, dictionary: DataFrame,
                   code_col: str = "ccs") -> DataFrame:
    """Drop held-out codes from train and dev; test keeps them (scored unseen)."""
    held = (codes.select(F.col(code_col).alias("label")).distinct()
            .join(dictionary, "label").select("label_id"))
    masked = (note_labels_split.where(F.col("split").isin("train", "dev"))
              .join(held, "label_id", "left_anti"))
    return masked.unionByName(note_labels_split.where(~F.col("split").isin("train", "dev")))


def split_support_by_label(note_label_split: DataFrame, label: str = "label") -> DataFrame:
    """Positives per label in each split and the split's share of them."""
    note = F.struct(*note_key(note_label_split))            # a struct counts although its task is null
    c = note_label_split.groupBy(label, "split").agg(F.countDistinct(note).alias("positives"))
    share = F.col("positives") / F.sum("positives").over(Window.partitionBy(label))
    return c.withColumn("share", share)


def scorable_from_sparse(positives: DataFrame, sizes: DataFrame, group: Sequence[str] = ("task",),
                         label: str = "label_id", selected: Sequence[int] | None = None) -> DataFrame:
    """A6 on sparse labels: positives per (group, label) against rows per group (null groups count).

    `positives` has (group..., label, positives); `sizes` has (group..., n).
    The zero cells are never materialised.  ``selected`` as in ``scorable_labels``.
    """
    return _positions(join_null_safe(positives, sizes, list(group)), list(group), label, selected)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Unify `TEXT` / `notes` to `text` and `ICD10` to `label` (coalesce when both exist)."""
    cols = df.columns
    srcs = [c for c in ("text", "TEXT", "notes") if c in cols]
    out = df
    if srcs and srcs != ["text"]:
        out = out.withColumn("__text", F.coalesce(*[F.col(c) for c in srcs])).drop(*srcs)
        out = out.withColumnRenamed("__text", "text")
    if "ICD10" in cols and "label" in cols:
        out = out.withColumn("label", F.coalesce("label", "ICD10")).drop("ICD10")
    elif "ICD10" in cols:
        out = out.withColumnRenamed("ICD10", "label")
    return out


TRANSLATIONS = ("official_translation", "Opus_el_en")


def select_translation(df: DataFrame, selector: str) -> DataFrame:
    """The chosen translation becomes `notes`; the original is kept as `org_notes`, the other translation as it is."""
    if selector not in TRANSLATIONS:
        raise ValueError(f"unknown translation column {selector!r}; expected one of {TRANSLATIONS}")
    rest = [c for c in df.columns if c not in ("notes", selector)]
    return df.select(*rest, F.col(selector).alias("notes"), F.col("notes").alias("org_notes"))


def filter_tasks(df: DataFrame, tasks: Sequence[str], match: str = "equal") -> DataFrame:
    """P5: keep rows of the requested tasks; `contains` reproduces substring matching."""
    if match == "equal":
        return df.where(F.col("task").isin(list(tasks)))
    cond = F.lit(False)
    for t in tasks:
        cond = cond | F.col("task").contains(t)
    return df.where(cond)
