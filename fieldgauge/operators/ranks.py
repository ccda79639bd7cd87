"""Places, ranks and exact order statistics of groups of any size.

Rows are dealt out by ranges of (group, order), each range is sorted and written, and one count for each
range and group tells where its rows stand in their group. No task holds a group, however large it is or
however many of its values are equal: rows that tie are told apart by their place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.functions import finite
from fieldgauge.sources.files import written

PART_BITS = 33  # of monotonically_increasing_id(): the lower ones count within a task


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equal in all pairs of columns, nulls and undefined numbers included."""
    out = F.lit(True)
    for x, y in pairs:
        out = out & a[x].eqNullSafe(b[y])
    return out


def _placed(df: DataFrame, by: list[str], order: list[str], drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The written rows as a struct ``own`` (without the columns of ``drop``, in letters of any case), their keys, their
    range ``part``, place ``at`` and the size ``n`` of their group; and the names of the group's keys."""
    own = [c for c in df.columns if c.lower() not in {x.lower() for x in drop}]
    groups, values = [f"k{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    named = [F.col(c).alias(a) for c, a in zip([*by, *order], [*groups, *values], strict=True)]
    packed = df.select(*named, F.struct(*own).alias("own") if own else F.lit(None).alias("own"))
    parts, keys = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*groups, *values, "tie"]
    sorted_ = packed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kept = written(sorted_.drop("tie").withColumn("local", F.monotonically_increasing_id())).withColumn("part", F.shiftright("local", PART_BITS))
    counts = kept.groupBy("part", *groups).agg(F.min("local").alias("first"), F.count("*").alias("rows"))
    # as many rows in a group as ranges that it fills
    w = Window.partitionBy(*groups) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("part").alias("p"), *(F.col(g).alias(f"g{g}") for g in groups), (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    starts = written(starts)
    joined = kept.join(starts, (kept["part"] == starts["p"]) & _same(kept, starts, [(g, f"g{g}") for g in groups]))
    return joined.select(*groups, *values, "own", "part", (F.col("local") + F.col("shift")).alias("at"), "n"), groups


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "place", size: str | None = None) -> DataFrame:
    """Adds the gapless place from 0 of each row in its group, and the group's size if it is given a name.

    Nulls come first, undefined numbers last; a null group is one group. Rows that tie get
    neighbouring places. Without ``by`` all rows are one group. A column of a result's name, in letters of any
    case, is replaced; an empty table stays empty.
    """
    rows, _ = _placed(df, by, order, (place, size or place))
    return rows.select("own.*", F.col("at").alias(place), *([F.col("n").alias(size)] if size else []))


def ranked(df: DataFrame, by: list[str], value: str, first: str = "first", ties: str = "ties") -> DataFrame:
    """Adds to each row how many of its group are less (``first``) and how many are equal to it, itself included (``ties``).

    `first + 1` is its rank, `first + (ties + 1) / 2` its midrank. Equal values are counted within each range and
    then over the ranges that they fill, so a value that a third of the rows has is in no single task. Nulls
    are equal and the least, undefined numbers equal and the largest. Columns of a result's name are replaced.
    """
    rows, groups = _placed(df, by, [value], (first, ties))
    rows = written(rows)
    runs = rows.groupBy("part", *groups, "o0").agg(F.min("at").alias("first"), F.count("*").alias("ties"))
    w = Window.partitionBy(*groups, "o0")
    runs = runs.select(F.col("part").alias("p"), *(F.col(c).alias(f"g{c}") for c in (*groups, "o0")), F.min("first").over(w).alias("first"), F.sum("ties").over(w).alias("ties"))
    runs = written(runs)
    joined = rows.join(runs, (rows["part"] == runs["p"]) & _same(rows, runs, [(c, f"g{c}") for c in (*groups, "o0")]))
    return joined.select("own.*", F.col("first").alias(first), F.col("ties").alias(ties))


def middle(df: DataFrame, by: list[str], value: str, low: str = "low", high: str = "high") -> DataFrame:
    """by, and the two middle values of each group: equal for an odd number of values. Nulls are no values.

    A group without values has no row. Undefined numbers count as the largest; see `median`.
    """
    rows = numbered(df.select(*by, value).where(F.col(value).isNotNull()), by, [value], "_place", "_size")
    at = F.col("_place")
    mid = rows.where((at == F.floor((F.col("_size") - 1) / 2)) | (at == F.floor(F.col("_size") / 2)))
    return mid.groupBy(*by).agg(F.min(value).alias(low), F.max(value).alias(high))


def median(low: Column, high: Column) -> Column:
    """The median from the two middle values; of two infinities of one sign that one."""
    return F.when(low == high, low).otherwise(low + (high - low) / 2)


def with_medians(groups: DataFrame, df: DataFrame, by: list[str], value: str, low: str = "_low", high: str = "_high") -> DataFrame:
    """The rows of ``groups`` (one for each group) with the two middle finite values of ``value`` in ``df``, null where there is none."""
    mid = middle(df.where(finite(F.col(value))), by, value, "low_", "high_").withColumnsRenamed({c: f"g{i}_" for i, c in enumerate(by)})
    pairs = [(c, f"g{i}_") for i, c in enumerate(by)]
    return groups.join(mid, _same(groups, mid, pairs), "left").select(*groups.columns, F.col("low_").alias(low), F.col("high_").alias(high))
