"""Exact row numbers and prefix sums without one huge window partition.

A plain ``row_number().over(partitionBy(g).orderBy(k))`` sends every row of a
group to one task.  When one group holds a third of the table that task is the
whole job.  The two-level form used here splits each group into buckets of a
column that is monotone in the sort order (a prefix of a hash, or quantiles of
a key; null groups and null keys count like any other):

1. count rows per (group, bucket) — a partial aggregate, tiny output;
2. offsets = running sum of the counts over the buckets of a group — a window
   over (groups x buckets) rows, bounded by the bucket count;
3. row number inside (group, bucket) — a window whose partitions are buckets;
4. rank = offset + local row number.

The result equals the single-window row number exactly because the bucket is
a function of the leading sort key.

``range_row_number`` ranks by any composite key instead: rows are dealt by ranges of the whole key
(Spark samples the splitters), so ties of its first column are split too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.session import checkpointed

HASH_BUCKET_CHARS = 3          # 16**3 = 4096 buckets per group
QUANTILES = 128                # buckets per group of an ordered key, a power of two
RANGES = 128                   # ranges of a composite key


def seeded_hash(seed: int | str, *cols: str) -> Column:
    """md5 over `seed:col1:col2...` — the same string in Spark and DuckDB."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_bucket(h: Column) -> Column:
    return F.substring(h, 1, HASH_BUCKET_CHARS)


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which null equals null; the left columns stay, ``right`` adds its others."""
    own = right.withColumnsRenamed({c: f"__right_{c}" for c in cols})
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(own[f"__right_{c}"])
    return left.join(own, on, how).drop(*[f"__right_{c}" for c in cols])


def _number(df: DataFrame, key: str) -> Column | None:
    """A double that never decreases along the key; None for text."""
    kind = df.schema[key].dataType.typeName()
    if kind.startswith("timestamp"):        # timestamp / timestamp_ntz: microseconds
        return F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(key).cast("double")
    return None if kind in ("string", "binary") else F.col(key).cast("double")


def with_order_bucket(df: DataFrame, groups: Sequence[str], key: str, out: str = "__order_bucket") -> DataFrame:
    """Add a bucket that never decreases along ``key`` inside each group, with boundaries from the data.

    Numbers and times: approximate quantiles of the group, so crowded or far-off values fill no
    bucket alone (equal values share one).  Text: the three characters after what the
    least and greatest key of the group have in common.  Null keys get the first bucket.
    """
    g, k = list(groups), _number(df, key)
    if k is not None:
        at = [i / QUANTILES for i in range(1, QUANTILES)]
        known = df.groupBy(*g).agg(F.percentile_approx(k, at, 20 * QUANTILES).alias("__bounds"))
        d = join_null_safe(df, known, g) if g else df.withColumn("__bounds", known.scalar())
        steps = F.array(*[F.lit(QUANTILES >> i) for i in range(1, QUANTILES.bit_length())])      # binary search
        found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("__bounds", at + step - 1) < k, step).otherwise(0))
        return d.withColumn(out, F.when(F.col(key).isNull(), -1).otherwise(found)).drop("__bounds")
    text = F.col(key).cast("string")
    known = df.groupBy(*g).agg(F.min(text).alias("__lo"), F.max(text).alias("__hi"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("__lo"), F.length("__hi")))), F.lit(0),
                       lambda n, i: F.when((n == i - 1) & (F.substring("__lo", 1, i) == F.substring("__hi", 1, i)), i).otherwise(n))
    known = known.select(*g, same.alias("__same"))
    d = join_null_safe(df, known, g) if g else df.withColumn("__same", known.scalar())
    return d.withColumn(out, F.substring(text, F.col("__same") + 1, F.lit(3))).drop("__same")


def two_level_row_number(df: DataFrame, groups: Sequence[str], bucket: Column,
                         order: Sequence[Column], out: str = "rn", size_out: str | None = None) -> DataFrame:
    """Add `out` = row_number() over (partition by groups order by order...).

    `bucket` must be non-decreasing along `order` (e.g. a prefix of the first
    sort key).  `order` must be a total order inside a group.  With `size_out`
    the row count of the group is added too (taken from the bucket counts, so
    it costs no extra pass over the rows).
    """
    b = "__bucket"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__n"))
    wg = Window.partitionBy(*groups)
    wb = wg.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    cols = [*groups, b, F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__off")]
    if size_out:
        cols.append(F.sum("__n").over(wg).alias(size_out))
    offsets = counts.select(*cols)
    local = F.row_number().over(Window.partitionBy(*groups, b).orderBy(*order))
    return (d.withColumn("__local", local)
            .transform(lambda x: join_null_safe(x, offsets, [*groups, b]))
            .withColumn(out, (F.col("__off") + F.col("__local")).cast("long"))
            .drop(b, "__off", "__local"))


def two_level_scan(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column],
                   value: str, out: str, agg: str = "sum", inclusive: bool = False) -> DataFrame:
    """Running sum or max of `value` along `order` inside each group.

    `inclusive=False` covers the rows strictly before this one; `True` includes
    it.  Bucket totals give the part from earlier buckets; a window inside the
    bucket gives the rest.  Null values are ignored, as by the plain window.
    """
    fn = {"sum": F.sum, "max": F.max}[agg]
    b = "__bucket"
    d = df.withColumn(b, bucket)
    totals = d.groupBy(*groups, b).agg(fn(value).alias("__t"))
    wb = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, b, fn("__t").over(wb).alias("__off"))
    end = 0 if inclusive else -1
    wl = Window.partitionBy(*groups, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    j = join_null_safe(d.withColumn("__local", fn(value).over(wl)), offsets, [*groups, b])
    if agg == "sum":
        res = F.coalesce(F.col("__off"), F.lit(0)) + F.coalesce(F.col("__local"), F.lit(0))
    else:
        res = F.greatest(F.col("__off"), F.col("__local"))      # greatest skips nulls
    return j.withColumn(out, res).drop(b, "__off", "__local")


def two_level_prefix_sum(df: DataFrame, groups: Sequence[str], bucket: Column,
                         order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add `out` = sum(value) over rows strictly before this one in `order` inside its group."""
    return two_level_scan(df, groups, bucket, order, value, out, "sum", inclusive=False)


def ordered_row_number(df: DataFrame, groups: Sequence[str], key: str, tiebreak: Sequence[str] = (),
                       out: str = "rn") -> DataFrame:
    """row_number() over (partition by groups order by key, tiebreak...), two-level (numbers, times or text)."""
    d = with_order_bucket(df, groups, key)
    order = [F.col(key), *[F.col(c) for c in tiebreak]]
    return two_level_row_number(d, groups, F.col("__order_bucket"), order, out).drop("__order_bucket")


def dealt_by_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[Column], at: str, ranges: int = RANGES) -> DataFrame:
    """The rows in ranges of (groups, order), sorted there and written once; ``at`` grows along that order, by one from row to
    row of a range, whose number is in the bits from 33 on."""
    dealt = df.repartitionByRange(ranges, *[F.col(c) for c in groups], *order).sortWithinPartitions(*[F.col(c) for c in groups], *order)
    return checkpointed(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges")


def range_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rn", ranges: int = RANGES) -> DataFrame:
    """row_number() over (partition by groups order by order...), by ranges of the composite key (groups, order).

    The rows are dealt into ``ranges`` ranges, sorted and numbered there, and written once.  A range's place in
    its group is the running sum of the counts before it: one row per group and range that it touches.  So a
    group of any size, and any number of rows that tie in the first columns of ``order``, is spread over ranges.
    """
    g, at, run = list(groups), "__at", "__range"
    rows = dealt_by_ranges(df, g, order, at, ranges).withColumn(run, F.shiftright(at, 33))
    counts = rows.groupBy(*g, run).agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*g).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*g, run, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    number = (F.col("__off") + F.col(at) - F.col("__first") + 1).cast("long")
    return join_null_safe(rows, starts, [*g, run]).withColumn(out, number).drop(at, run, "__first", "__off")
