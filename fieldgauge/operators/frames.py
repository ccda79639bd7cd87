"""Per-frame statistics and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, INF, variance, vrmse
from fieldgauge.sources.views import FIELDS, FRAME

SITE = ["file", "trajectory", "field_idx", "site"]


def frame_variance(cells: DataFrame, keys: list[str] = FRAME, fields: list[str] = FIELDS, ddof: int = 1) -> DataFrame:
    """Variance of each field over the cells of a frame; one partial and one final aggregation."""
    f = F.var_samp if ddof == 1 else F.var_pop
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), *(f(c).alias(f"var_{c}") for c in fields))


def long_variance(cells: DataFrame, ddof: int = 1) -> DataFrame:
    """file, trajectory, t, field, field_idx, var: the frame variances, one row for each field."""
    wide = frame_variance(cells, ddof=ddof)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_idx"), F.col(f"var_{f}").alias("var")) for i, f in enumerate(FIELDS)))
    return wide.select(*FRAME, F.inline(each))


def frame_rms2(cells: DataFrame) -> DataFrame:
    """Mean square of each field over the cells of a frame; nulls do not count, a frame of nulls gives null."""
    return cells.groupBy(*FRAME).agg(*(F.avg(F.col(f) * F.col(f)).alias(f"rms2_{f}") for f in FIELDS))


def identity_check(cells: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Whether the mean square is the population variance and the squared mean, in one pass."""
    sums = cells.groupBy(*FRAME).agg(*(g(f).alias(f"{n}_{f}") for f in FIELDS for n, g in (("ms", lambda c: F.avg(F.col(c) * F.col(c))), ("vp", F.var_pop), ("mean", F.avg))))
    ok = [F.abs(F.col(f"ms_{f}") - F.col(f"vp_{f}") - F.col(f"mean_{f}") ** 2) <= tol * F.greatest(F.col(f"ms_{f}"), F.lit(1e-300)) + 1e-15 for f in FIELDS]
    return sums.select(*FRAME, *(o.alias(f"holds_{f}") for o, f in zip(ok, FIELDS, strict=True)))


def frame_mse(pred: DataFrame, target: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean squared error of two aligned tables (`x`); a key that only one has is an error."""
    both = target.select(*keys, F.col("x").alias("target")).join(pred.select(*keys, F.col("x").alias("pred")), keys, "full")
    d = F.when(F.col("target").isNull() | F.col("pred").isNull(), F.raise_error(F.lit("prediction and target have different shapes"))).otherwise(F.col("pred") - F.col("target"))
    return both.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def spatial_mean(cells: DataFrame) -> DataFrame:
    """Mean of each field over the cells of a frame; nulls do not count, a frame of nulls gives null."""
    return cells.groupBy(*FRAME).agg(*(F.avg(f).alias(f"mean_{f}") for f in FIELDS))


def persistence_mse(grid: DataFrame) -> DataFrame:
    """The previous frame as a forecast, reset at each trajectory; null on a first frame."""
    w = Window.partitionBy(*SITE).orderBy("t")
    d = F.col("x") - F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("x").over(w))
    return grid.select(*FRAME, "field", "field_idx", (d * d).alias("d2")).groupBy(*FRAME, "field", "field_idx").agg(F.avg("d2").alias("persistence_mse"))


def frame_stats(grid: DataFrame) -> DataFrame:
    """Persistence error, sample variance and mean of each frame and field: one lag and one aggregation over the grid.

    ``persistence_mse`` is null where there is no frame before; nulls of x do not count.
    """
    w = Window.partitionBy(*SITE).orderBy("t")
    d = F.col("x") - F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("x").over(w))
    return grid.select(*FRAME, "field", "field_idx", "x", (d * d).alias("d2")).groupBy(*FRAME, "field", "field_idx").agg(F.avg("d2").alias("persistence_mse"), F.var_samp("x").alias("var"), F.avg("x").alias("mean"))


def prediction_variance(preds: DataFrame) -> DataFrame:
    """Variance of the predicted frame, as `functions.variance`; null where fewer than two sites have one."""
    return preds.groupBy("model", "mode", *FRAME, "field").agg(variance(F.col("pred")).alias("pvar"))


ROW = ["model", "mode", *FRAME, "rollout_step", "input_start"]


def field_mean_vrmse(rows: DataFrame, eps: float | Column, name: str = "score", keys: list[str] | None = None) -> DataFrame:
    """The mean score over the fields of each score row; eps None means no floor."""
    return rows.groupBy(*(keys or ROW)).agg(F.avg(vrmse(F.col("mse"), F.col("var"), 0.0 if eps is None else eps)).alias(name))


def well_conditioned(rows: DataFrame, threshold: float = EPS_FIX) -> DataFrame:
    """Whether every field of a score row has a variance above the threshold; a null variance has not."""
    return rows.groupBy(*ROW).agg(F.bool_and(F.coalesce(F.col("var") > threshold, F.lit(False))).alias("conditioned"))


def relative_difference(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """max |a - b| / max(max |a|, 1e-30); infinite where one lacks an element."""
    both = a.select(*keys, F.col("x").alias("a")).join(b.select(*keys, F.col("x").alias("b")), keys, "full")
    lacks = F.max((F.col("a").isNull() | F.col("b").isNull()).cast("int"))
    return both.groupBy(*by).agg(F.when(lacks == 1, INF).otherwise(F.max(F.abs(F.col("a") - F.col("b"))) / F.greatest(F.max(F.abs("a")), F.lit(1e-30))).alias("rel_diff"))


def max_difference(preds: DataFrame) -> DataFrame:
    """Largest absolute difference overall and for each rollout step, by one rollup."""
    d = preds.where("mode = 'rollout'")
    return d.rollup("model", "rollout_step").agg(F.max(F.abs(F.col("pred") - F.col("target"))).alias("max_abs_diff"), F.grouping("rollout_step").alias("overall")).where("model is not null")


def mean_predictor(rows: DataFrame, eps: float = EPS) -> DataFrame:
    """The score that predicting each frame's own mean would have: mse = var (N - 1) / N."""
    return rows.withColumn("baseline_mse", F.col("var") * (F.col("n_cells") - 1) / F.col("n_cells")).withColumn("baseline", vrmse(F.col("baseline_mse"), F.col("var"), eps))
