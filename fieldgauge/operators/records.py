"""Checks of published records: geometry, copies, chronologies, pinned counts, equivalence of two evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions import finite


def pinned(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """name, observed, expected and pinned of counts (name, n) that have to be what another table says (V6).

    A name that only one of them has is not pinned; its other count is null.
    """
    a, b = observed.select("name", F.col("n").alias("observed")), expected.select("name", F.col("n").alias("expected"))
    return a.join(b, "name", "full").withColumn("pinned", F.coalesce(F.col("observed") == F.col("expected"), F.lit(False)))


def bulk_window(records: DataFrame, day: str, captured: str, by: list[str], when: str = "ts") -> DataFrame:
    """Per group: records on a day, their span in seconds, the other days that records are on, and whether none is later
    than the capture (V10). A null time is on no day and counts in `n` only; a group without records on the day has a null span."""
    t = F.col(when)
    on = F.to_date(t) == F.lit(day).cast("date")
    at = F.when(on, F.unix_timestamp(t))
    others = F.array_sort(F.collect_set(F.when(~on, F.to_date(t).cast("string"))))
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(on).alias("n_on_day"), (F.max(at) - F.min(at)).alias("span"), F.array_join(others, ",").alias("outside"), (F.count_if(t > F.lit(captured).cast("timestamp")) == 0).alias("none_after"))


def chronology(records: DataFrame, by: str, anchors: dict[str, str], when: str = "ts") -> DataFrame:
    """Per group the first and last day of its records, whether it was revised after the first, and the days from each anchor
    to the first (``after_<name>``) (V11). Groups without a day have nulls."""
    day = F.to_date(when)
    first, last = F.min(day), F.max(day)
    gaps = [F.datediff(first, F.lit(d).cast("date")).alias(f"after_{a}") for a, d in anchors.items()]
    return records.groupBy(by).agg(F.count("*").alias("n"), first.alias("first_day"), last.alias("last_day"), (first != last).alias("revised"), *gaps)


def chronology_summary(groups: DataFrame, anchors: dict[str, str]) -> DataFrame:
    """One row over the groups of `chronology`: whether all began on one day, any was revised, least and most days after each anchor."""
    gaps = [f(f"after_{a}").alias(f"{n}_after_{a}") for a in anchors for n, f in (("least", F.min), ("most", F.max))]
    return groups.agg(F.count("*").alias("n_groups"), (F.countDistinct("first_day") == 1).alias("same_day"), F.bool_or("revised").alias("any_revised"), *gaps)


def geometry(rows: DataFrame, frames: DataFrame, history: int = 4, least_steps: int = 13) -> DataFrame:
    """Whether a result record is coherent, for each (model, file).

    ``rows`` are score rows, ``frames`` has (file, trajectory, t) of the data. `steps` is the longest rollout, `long_enough` that it
    reaches ``least_steps``, `frames_enough` that each trajectory has frames for history and steps, `windows_complete` that
    one-step windows are (frames - history) summed over the trajectories, `shapes_match` that every window has all fields,
    each on the same number of cells in its frame, and `all_zero` that no prediction varies.
    """
    have = frames.groupBy("file", "trajectory").agg(F.countDistinct("t").alias("frames")).groupBy("file").agg(F.min("frames").alias("least_frames"), F.sum(F.greatest(F.col("frames") - history, F.lit(0))).alias("expected"))
    keys = ["model", "file", "mode", "trajectory", "t"]
    window = rows.groupBy(*keys).agg(F.count("*").alias("fields"), F.max("rollout_step").alias("step"), (F.min("n_cells") == F.max("n_cells")).alias("even"), F.max(F.coalesce("pvar", F.lit(0.0))).alias("spread"))
    per = window.groupBy("model", "file").agg(F.max("step").alias("steps"), F.count_if(F.col("mode") == "onestep").alias("windows"), ((F.min("fields") == F.max("fields")) & F.bool_and("even")).alias("shapes_match"), (F.max("spread") == 0).alias("all_zero"))
    out = per.join(have, "file", "left")
    return out.select("model", "file", "steps", "windows", "expected", F.coalesce(F.col("steps") >= least_steps, F.lit(False)).alias("long_enough"), F.coalesce(F.col("least_frames") >= history + F.col("steps"), F.lit(False)).alias("frames_enough"), F.coalesce(F.col("windows") == F.col("expected"), F.lit(False)).alias("windows_complete"), "shapes_match", "all_zero")


def derived_counts(cells: DataFrame, stored: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Summary counts that are stored beside a table against those that its cells give (V14): cells, and those above the limit.

    ``cells`` has ``by`` and value, ``stored`` ``by``, n_cells and n_above. A group that only one of them has does not follow.
    """
    made = cells.groupBy(*by).agg(F.count("*").alias("derived_cells"), F.count_if(F.col("value") > limit).alias("derived_above"))
    both = stored.join(made, by, "full")
    same = (F.col("n_cells") == F.col("derived_cells")) & (F.col("n_above") == F.col("derived_above"))
    return both.withColumn("follows", F.coalesce(same, F.lit(False)))


def equivalence(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str = "mse") -> DataFrame:
    """Per group the two legs of an evaluation, window by window (W36): how many windows either has, how many both,
    whether all were compared, the worst difference absolutely and relative to the first leg, and whether all are identical.

    Two undefined values of a window are identical; an undefined and a defined one are not, and differ infinitely.
    """
    x, y = F.col("_x"), F.col("_y")
    both = a.select(*keys, F.col(value).cast("double").alias("_x"), F.lit(1).alias("_a")).join(b.select(*keys, F.col(value).cast("double").alias("_y"), F.lit(1).alias("_b")), keys, "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = F.coalesce(x.eqNullSafe(y), F.lit(False))
    far = F.when(met, F.when(same, 0.0).when(finite(x) & finite(y), F.abs(x - y)).otherwise(float("inf")))
    return both.groupBy(*by).agg(F.count("*").alias("n_windows"), F.count_if(met).alias("n_compared"), (F.count_if(met) == F.count("*")).alias("complete"), F.max(far).alias("worst"), F.max(F.when((far == 0) | (far == float("inf")), far).otherwise(far / F.greatest(F.abs(x), F.lit(1e-30)))).alias("worst_relative"), F.bool_and(met & same).alias("identical"))


def dataset_of(file: Column) -> Column:
    """The last token of a file's name between underscores, without `.hdf5`."""
    return F.regexp_replace(F.element_at(F.split(F.substring_index(file, "/", -1), "_"), -1), r"\.hdf5$", "")


def model_and_dataset(repo: Column) -> tuple[Column, Column]:
    """The tail of a repository's name split at its first dash; without a dash the dataset is null."""
    tail = F.substring_index(repo, "/", -1)
    return F.substring_index(tail, "-", 1), F.when(F.contains(tail, F.lit("-")), F.regexp_replace(tail, "^[^-]*-", ""))
