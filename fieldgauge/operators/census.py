"""Censuses of frame variances and the map of datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, floor_share, sig, vrmse
from fieldgauge.operators import ranks as R
from fieldgauge.sources.files import written

#: Windows that one table may have.
MOST_WINDOWS = 1000


def component_census(var: DataFrame, by: list[str] = ("file", "field"), first: str = "t") -> DataFrame:
    """Least, largest and mean variance, share of frames at each floor, frames and window."""
    v = F.col("var")
    return var.groupBy(*by).agg(
        F.min(v).alias("var_min"), F.max(v).alias("var_max"), F.avg(v).alias("var_mean"), F.avg((v <= EPS).cast("double")).alias("frac_le_eps"), F.avg((v <= EPS_FIX).cast("double")).alias("frac_le_fix"), F.count("*").alias("n_frames"), F.min(first).alias("t_first"), F.max(first).alias("t_last")
    )


def trajectory_audit(var: DataFrame, frames: tuple[int, int] = (4, 33)) -> DataFrame:
    """For each trajectory and field: frames at the floor, the last of them, variances at chosen frames.

    ``var_final`` is that of the last frame, null where that one is undefined.
    """
    v, t = F.col("var"), F.col("t")
    return var.groupBy("file", "trajectory", "field").agg(
        F.count_if(v <= EPS).alias("n_le"), F.max(F.when(v <= EPS, t)).alias("last_t_le"), F.min(v).alias("var_min"), *(F.max(F.when(t == k, v)).alias(f"var_t{k}") for k in frames), F.max_by("var", "t").alias("var_final")
    )


def window_coverage(var: DataFrame, fields: list[str], lo: int, hi: int) -> DataFrame:
    """Share of a window's frames at the floor, least over the fields, by trajectory; then over all."""
    per_field = var.where(F.col("field").isin(fields) & F.col("t").between(lo, hi)).groupBy("file", "trajectory", "field").agg(F.avg((F.col("var") <= EPS_FIX).cast("double")).alias("share"))
    per = per_field.groupBy("file", "trajectory").agg(F.min("share").alias("share"))
    return per.groupBy("file").agg(F.avg("share").alias("mean"), F.min("share").alias("least"), F.max("share").alias("most"), F.count_if(F.col("share") == 1).alias("n_wholly"), F.count("*").alias("n_trajectories"))


def dataset_rollup(census: DataFrame, by: str = "file") -> DataFrame:
    """Per dataset the field of the least variance (first of equals) with its largest shares."""
    fields = census.groupBy(by, "field").agg(F.min("var_min").alias("min_var"), F.max("frac_le_eps").alias("frac_le_eps"), F.max("frac_le_fix").alias("frac_le_fix"))
    best = F.min(F.struct("min_var", "field", "frac_le_eps", "frac_le_fix")).alias("b")
    return fields.groupBy(by).agg(best).select(by, "b.*")


def categories(rollup: DataFrame, published: DataFrame, key: str = "file") -> DataFrame:
    """Susceptibility and category of each dataset; a dataset without a published status has `?`."""
    joined = rollup.join(published, key, "left").withColumn("gt10", F.coalesce("gt10", F.lit("?")))
    severe, fix, yes = F.col("min_var") <= EPS, F.col("min_var") <= EPS_FIX, F.col("gt10") == "yes"
    cat = F.when(severe & yes, "library_floored").when(severe, "library_floored_no_headline").when(fix & yes, "floor_sensitive_gt10").when(fix, "floor_sensitive_no_gt10").when(yes, "no_susceptibility_gt10").otherwise("well_conditioned")
    return joined.withColumns({"susceptibility": F.when(severe, "severe").when(fix, "susceptible").otherwise("healthy"), "category": cat, "floor_share": sig(floor_share(F.col("min_var"), EPS))})


CATEGORY_ORDER = ["triggered_audited", "library_floored", "library_floored_no_headline", "floor_sensitive_gt10", "floor_sensitive_no_gt10", "no_susceptibility_gt10", "well_conditioned"]


def map_order(mapped: DataFrame) -> DataFrame:
    """Rows by category rank, then by least variance, with their place."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    return mapped.withColumn("place", F.row_number().over(Window.orderBy(rank, "min_var", "file")))


def persistence_curve(stats: DataFrame, eps: float = EPS) -> DataFrame:
    """Mean score over the fields of each frame for persistence, from `frames.frame_stats`; frames without one before are left out."""
    return stats.where("persistence_mse is not null").groupBy("file", "trajectory", "t").agg(F.avg(vrmse(F.col("persistence_mse"), F.col("var"), eps)).alias("score"))


def window_table(joined: DataFrame, windows: DataFrame) -> DataFrame:
    """Statistics of each (window, field) over the frames that a window holds; windows may overlap.

    The windows (label, lo, hi) are few and become part of the plan, so no table is joined with them.
    """
    kept = windows.select("label", "lo", "hi").collect()
    if len(kept) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    held = F.filter(F.array(*(F.struct(F.lit(w.label).alias("label"), F.lit(w.lo).alias("lo"), F.lit(w.hi).alias("hi")) for w in kept)), lambda w: F.col("t").between(w["lo"], w["hi"]))
    at = written(joined.select("field", "var", "persistence_mse", F.explode(held["label"]).alias("label")))
    a, b = vrmse(F.col("persistence_mse"), F.col("var"), EPS), vrmse(F.col("persistence_mse"), F.col("var"), EPS_FIX)
    out = at.groupBy("label", "field").agg(
        F.avg((F.col("var") <= EPS).cast("double")).alias("frac_le_eps"), F.avg(a / b).alias("ratio"), F.max(a).alias("max_eps"), F.avg(a).alias("mean_eps"), F.max(b).alias("max_fix"), F.avg(b).alias("mean_fix"),
        F.min("var").alias("var_min"), F.max("var").alias("var_max"), F.count("*").alias("n"),
    )
    return R.with_medians(out, at, ["label", "field"], "var").withColumn("var_median", R.median(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def isolated(inputs: DataFrame, census, schema: str) -> DataFrame:
    """The inputs with what ``census(row as a dict) -> dict`` gives, and ``error``: one that fails is recorded
    with its error and nulls in place of results, and the others go on (M10). Columns of these names are replaced."""
    made = [f.strip().split()[0] for f in schema.split(",")]
    keep = [f"`{n}` {t}" for n, t in inputs.dtypes if n not in (*made, "error")]

    def run(batches):
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                try:
                    rows.append({**row, **census(row), "error": None})
                except Exception as e:  # whatever a broken input raises is its record
                    rows.append({**row, **dict.fromkeys(made), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*(n for n in b.columns if n not in (*made, "error")), *made, "error"])

    return inputs.mapInPandas(run, ", ".join([*keep, schema, "error string"]))
