"""Aggregates of score rows: windows, curves, weights, phases, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, WINDOWS, finite, safe_div, vrmse
from fieldgauge.operators import ranks as R
from fieldgauge.sources.files import written

TRAJ = ["file", "trajectory"]


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "label string, lo int, hi int")


def scored(rows: DataFrame, floors: list[float], mode: str) -> DataFrame:
    """Field-mean score of each row at each floor (`eps`, `score`), all floors in one pass."""
    keys = ["model", *TRAJ, "rollout_step", "input_start"]
    each = rows.where(F.col("mode") == mode).select(*keys, "mse", "var", F.explode(F.array(*map(F.lit, floors))).alias("eps"))
    return each.groupBy(*keys, "eps").agg(F.avg(vrmse(F.col("mse"), F.col("var"), F.col("eps"))).alias("score"))


def per_trajectory_windows(scores: DataFrame, wins: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Mean within each window for each trajectory: the first level of the window mean."""
    at = scores.join(F.broadcast(wins), F.col("rollout_step").between(F.col("lo"), F.col("hi")))
    return at.groupBy(*by, *TRAJ, "label", "eps").agg(F.avg("score").alias("score"))


def window_means(scores: DataFrame, wins: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Mean over trajectories of their window means; every trajectory weighs the same."""
    return per_trajectory_windows(scores, wins, by).groupBy(*by, "label", "eps").agg(F.avg("score").alias("score"), F.count("*").alias("n_trajectories"))


def conditioned_windows(rows: DataFrame, wins: DataFrame, eps: float = EPS, threshold: float = EPS_FIX) -> DataFrame:
    """Pooled mean of the window's well-conditioned rows, with how many were used."""
    row = rows.where("mode = 'rollout'").groupBy("model", *TRAJ, "rollout_step").agg(F.avg(vrmse(F.col("mse"), F.col("var"), eps)).alias("score"), F.bool_and(F.coalesce(F.col("var") > threshold, F.lit(False))).alias("good"))
    at = row.join(F.broadcast(wins), F.col("rollout_step").between(F.col("lo"), F.col("hi")))
    return at.groupBy("model", "label").agg(F.avg(F.when(F.col("good"), F.col("score"))).alias("score"), F.count_if("good").alias("n_used"), F.count("*").alias("n_total"))


def interpolated_mean(points: DataFrame, lo: int, hi: int, by: list[str]) -> DataFrame:
    """Linear interpolation of (x, y) onto the grid lo..hi, flat outside of the samples, then the mean.

    Neighbouring samples are paired by a lead; each segment makes its own grid points, so no grid point
    looks for its neighbours.
    """
    w = Window.partitionBy(*by).orderBy("x")
    seg = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "x0": F.lag("x").over(w)})
    first = F.when(F.col("x0").isNull(), F.lit(lo)).otherwise(F.col("x"))
    last = F.when(F.col("x2").isNull(), F.lit(hi)).otherwise(F.col("x2") - 1)
    a, b = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi))
    at = seg.where(a <= b).withColumn("g", F.explode(F.sequence(a.cast("int"), b.cast("int"))))
    inside = (F.col("g") >= F.col("x")) & F.col("x2").isNotNull()
    y = F.when(inside, F.col("y") + (F.col("y2") - F.col("y")) * (F.col("g") - F.col("x")) / (F.col("x2") - F.col("x"))).otherwise(F.col("y"))
    return at.groupBy(*by).agg(F.avg(y).alias("mean"), F.count("*").alias("n_grid"))


def trapezoid(points: DataFrame, by: list[str]) -> DataFrame:
    """Span-weighted mean of (x, y): the trapezoid area over the span; one point or no span: the mean."""
    w = Window.partitionBy(*by).orderBy("x")
    seg = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    span = F.max("x") - F.min("x")
    area = F.sum((F.col("y") + F.col("y2")) / 2 * (F.col("x2") - F.col("x")))
    return seg.groupBy(*by).agg(F.when(span > 0, area / span).otherwise(F.avg("y")).alias("weighted"), F.avg("y").alias("plain"), F.count("*").alias("n"))


def starts(rows: DataFrame, floors: list[float]) -> DataFrame:
    """One-step score rows as points (x = start), with the least field variance of each."""
    keys = ["model", *TRAJ, "input_start"]
    each = rows.where("mode = 'onestep'").select(*keys, "mse", "var", F.explode(F.array(*map(F.lit, floors))).alias("eps"))
    return each.groupBy(*keys, "eps").agg(F.avg(vrmse(F.col("mse"), F.col("var"), F.col("eps"))).alias("y"), F.min("var").alias("min_var")).withColumnRenamed("input_start", "x")


def phase_split(points: DataFrame, threshold: float = EPS_FIX) -> DataFrame:
    """Quiescent and developed means per model and floor; the lead runs within a phase."""
    phased = points.withColumn("quiet", F.col("min_var") <= threshold).where("quiet is not null")
    per = trapezoid(phased, ["model", "eps", *TRAJ, "quiet"])
    out = per.groupBy("model", "eps").agg(*(F.avg(F.when(F.col("quiet") == q, F.col(c))).alias(f"{n}_{c}") for q, n in ((True, "quiescent"), (False, "developed")) for c in ("weighted", "plain")), *(F.sum(F.when(F.col("quiet") == q, F.col("n")).otherwise(0)).alias(f"n_{n}") for q, n in ((True, "quiescent"), (False, "developed"))))
    return out.withColumn("ratio", safe_div(F.col("quiescent_weighted"), F.col("developed_weighted")))


def quiescent_fraction(rows: DataFrame, threshold: float = EPS_FIX) -> DataFrame:
    """Share of a file's starts whose least field variance is at the threshold; models must agree on them."""
    low = rows.where("mode = 'onestep'").groupBy("model", *TRAJ, "input_start").agg(F.min("var").alias("v"))
    per_start = low.groupBy(*TRAJ, "input_start").agg(F.min("v").alias("v"), F.max("v").alias("v2"), F.count("*").alias("n"))
    models = low.agg(F.countDistinct("model").alias("n_models"))
    agreed = per_start.crossJoin(F.broadcast(models)).withColumn("v", F.when((F.col("n") != F.col("n_models")) | (F.abs(F.col("v2") - F.col("v")) > 1e-9 * F.abs(F.col("v"))), F.raise_error(F.lit("start grid or target variance differs across models"))).otherwise(F.col("v")))
    return agreed.groupBy("file").agg(F.count("*").alias("n_starts"), F.count_if(F.col("v") <= threshold).alias("n_quiescent"), F.avg((F.col("v") <= threshold).cast("double")).alias("quiescent_fraction"), F.min("v").alias("min_field_variance"))


def last_trajectory_counterfactual(scores: DataFrame, wins: DataFrame) -> DataFrame:
    """What reporting the last trajectory alone would give, against all of them."""
    per = per_trajectory_windows(scores, wins)
    return per.groupBy("model", "label", "eps").agg(F.max_by("score", F.struct(*TRAJ)).alias("last"), F.avg("score").alias("all")).withColumn("ratio", safe_div(F.col("last"), F.col("all")))


def last_trajectory_curves(scores: DataFrame) -> DataFrame:
    """Per rollout step the last trajectory's score, and the mean, least and most over all trajectories."""
    per = scores.groupBy("model", "eps", "rollout_step")
    out = per.agg(F.max_by("score", F.struct(*TRAJ)).alias("last"), F.avg("score").alias("all"), F.min("score").alias("least"), F.max("score").alias("most"))
    return out.withColumn("ratio", safe_div(F.col("last"), F.col("all")))


def two_floors(points: DataFrame, at: str, low: float = EPS, high: float = EPS_FIX) -> DataFrame:
    """Mean over trajectories of `y` at each ``at`` (a start or a step) under two floors, and their ratio."""
    mean = lambda e: F.avg(F.when(F.col("eps") == e, F.col("y")))
    return points.groupBy("model", at).agg(mean(low).alias("at_eps"), mean(high).alias("at_fix"), safe_div(mean(low), mean(high)).alias("ratio"))


def surface_differences(means: DataFrame, published: DataFrame) -> DataFrame:
    """Field means (model, field, score) less each published surface (surface, field, value) (W33); a field that a surface lacks has no row."""
    return means.join(published, "field").withColumn("difference", F.col("score") - F.col("value"))


def first_divergent_step(rows: DataFrame, limit: float = 1e6) -> DataFrame:
    bad = ~finite(F.col("mse")) | (F.col("mse") > limit)
    return rows.where("mode = 'rollout'").groupBy("model", *TRAJ).agg(F.min(F.when(bad, F.col("rollout_step"))).alias("first_bad_step"), F.max("mse").alias("max_mse"))


def crossings(cells: DataFrame, limit: float = 10.0) -> DataFrame:
    """Per floor the cells above the limit and the names of those that are not."""
    return cells.groupBy("eps").agg(F.count_if(F.col("score") > limit).alias("n_above"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("score") <= limit, F.concat_ws("/", "model", "label")))), ",").alias("not_above"))


def separation(strata: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest predictor of strata that never cross against the least of those that always do."""
    a, b = F.max(F.when(F.col("n_above") == 0, F.col("predictor"))), F.min(F.when(F.col("n_above") == F.col("n"), F.col("predictor")))
    return strata.groupBy(*(by or [])).agg(a.alias("max_never"), b.alias("min_always"), F.coalesce(a < b, F.lit(False)).alias("separates"), F.count("*").alias("n_strata"))


def midranks(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Adds rank_<column>, from 1: rows that tie share the mean of their ranks. Nulls tie and come first."""
    for c in cols:
        df = R.ranked(df, by, c, "_first", "_ties").withColumn(f"rank_{c}", F.col("_first") + (F.col("_ties") + 1) / 2).drop("_first", "_ties")
    return df


def dispersion(scores: DataFrame, by: list[str]) -> DataFrame:
    """Spread of trajectory scores, with the means that leave one out."""
    scores = written(scores.select(*by, "score"))
    n, total = F.count("*"), F.sum("score")
    # the mean without one score is least where the largest is left out
    without = lambda c: F.when(n > 1, (total - c) / (n - 1))
    out = scores.groupBy(*by).agg(F.min("score").alias("least"), F.max("score").alias("most"), safe_div(F.max("score"), F.min("score")).alias("ratio"), (100 * safe_div(F.stddev_samp("score"), F.avg("score"))).alias("cv"), without(F.max("score")).alias("loo_least"), without(F.min("score")).alias("loo_most"))
    return R.with_medians(out, scores, by, "score").withColumn("median", R.median(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def tail_slope(points: DataFrame) -> DataFrame:
    """The last two samples of each trajectory and the drop between them in percent."""
    r = F.row_number().over(Window.partitionBy("model", "eps", *TRAJ).orderBy(F.col("x").desc()))
    two = points.withColumn("r", r).where("r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    out = two.groupBy("model", "eps", *TRAJ).agg(pick(2, "x").alias("x_before"), pick(1, "x").alias("x_last"), pick(2, "y").alias("y_before"), pick(1, "y").alias("y_last"))
    return out.withColumn("drop_percent", 100 * safe_div(F.col("y_before") - F.col("y_last"), F.col("y_before")))


def exact_steps(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Whether a trajectory has each step of the window once: no gap and no repeat."""
    per = rows.where(F.col("mode") == "rollout").where(F.col("rollout_step").between(lo, hi)).groupBy("model", *TRAJ).agg(F.count("*").alias("n"), F.countDistinct("rollout_step").alias("distinct_steps"), F.count_if(F.col("field_idx") == 0).alias("n_first"))
    size = hi - lo + 1
    return per.withColumn("exact", (F.col("distinct_steps") == size) & (F.col("n_first") == size))


def displacements(rows: DataFrame) -> DataFrame:
    """Rows whose error exceeds what both spreads together could explain, first field excepted."""
    far = F.sqrt("mse") > (F.sqrt("var") + F.sqrt("pvar")) * (1 + 1e-12)  # equality is no excess, whatever the order of sums
    return rows.where("field_idx > 0").groupBy("model", "mode", "field").agg(F.count_if(F.coalesce(far, F.lit(False))).alias("n_far"), F.count("*").alias("n"))


def set_sizes(rows: DataFrame, keys: list[str], a: str, b: str, distinct: str) -> DataFrame:
    """Sizes of two sets of keys, of their union, intersection and difference, and how many values ``distinct`` has.

    A key is in a set if one of its rows meets the condition; one grouping by key gives all of them.
    """
    in_a, in_b = F.coalesce(F.bool_or(F.expr(a)), F.lit(False)), F.coalesce(F.bool_or(F.expr(b)), F.lit(False))
    each = rows.groupBy(*dict.fromkeys([*keys, distinct])).agg(in_a.alias("_a"), in_b.alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    counts = {"n_a": x, "n_b": y, "n_union": x | y, "n_both": x & y, "n_only_a": x & ~y}
    return each.agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.countDistinct(distinct).alias(f"n_{distinct}s"))
