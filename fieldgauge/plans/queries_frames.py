"""Registered queries: frame statistics (A), the screen (C) and censuses (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, band, floor_share, safe_div, sig, vrmse
from fieldgauge.operators import census as M
from fieldgauge.operators import frames as A
from fieldgauge.operators import screen as C
from fieldgauge.plans.registry import VAR, S, query
from fieldgauge.sources import views as V
from fieldgauge.sources.views import FIELDS, FRAME

_VAR = "fv AS (SELECT file, trajectory, t, field, field_idx, var FROM (" + " UNION ALL ".join(f"SELECT file, trajectory, t, '{f}' AS field, {i} AS field_idx, var_samp({f}) AS var FROM cells GROUP BY file, trajectory, t" for i, f in enumerate(FIELDS)) + ") q)"
_BAND = "CASE WHEN share IS NULL OR isnan(share) OR isinf(share) THEN 'undefined' WHEN share < 0.01 THEN 'well-conditioned' WHEN share < 0.5 THEN 'floor-sensitive' WHEN share < 0.9 THEN 'floor-dominated' ELSE 'floor-determined' END"
_PERS = "pm AS (SELECT file, trajectory, t, field, field_idx, avg((x - p) * (x - p)) AS persistence_mse FROM (SELECT *, CASE WHEN lag(t) OVER w = t - 1 THEN lag(x) OVER w END AS p FROM grid WINDOW w AS (PARTITION BY file, trajectory, field_idx, site ORDER BY t)) q GROUP BY ALL)"
_GVAR = "gv AS (SELECT file, trajectory, t, field, var_samp(x) AS var FROM grid GROUP BY ALL)"


_NAN = "CAST('nan' AS DOUBLE)"


def sigs(df, *names):
    return df.withColumns({n: sig(F.col(n)) for n in names})


def gvar(g):
    return g.groupBy(*FRAME, "field").agg(F.var_samp("x").alias("var"))


@query("q_a1", "cells", "SELECT file, trajectory, t, count(*) AS n_cells, " + ", ".join(f"{S(f'var_samp({f})')} AS var_{f}" for f in FIELDS) + " FROM cells GROUP BY file, trajectory, t")
def q_a1(spark, d):
    return sigs(A.frame_variance(V.cells(spark, d)), *(f"var_{f}" for f in FIELDS))


@query("q_a2", "cells", "SELECT file, trajectory, t, " + ", ".join(f"{S(f'avg({f} * {f})')} AS rms2_{f}" for f in FIELDS) + " FROM cells GROUP BY file, trajectory, t")
def q_a2(spark, d):
    return sigs(A.frame_rms2(V.cells(spark, d)), *(f"rms2_{f}" for f in FIELDS))


@query("q_a3", "cells", "SELECT file, trajectory, t, " + ", ".join(f"abs(avg({f}*{f}) - var_pop({f}) - avg({f})*avg({f})) <= 1e-9 * greatest(avg({f}*{f}), 1e-300) + 1e-15 AS holds_{f}" for f in FIELDS) + " FROM cells GROUP BY file, trajectory, t")
def q_a3(spark, d):
    return A.identity_check(V.cells(spark, d))


@query("q_a4", "grid", f"SELECT file, trajectory, t, field, {S('avg((0.9 * x - x) * (0.9 * x - x))')} AS mse FROM grid GROUP BY ALL")
def q_a4(spark, d):
    g = V.grid(spark, d)
    return sigs(A.frame_mse(g.withColumn("x", F.lit(0.9) * F.col("x")), g, [*FRAME, "field", "site"], [*FRAME, "field"]), "mse")


@query("q_a5", "rows", f"SELECT model, mode, file, trajectory, t, field, {S('sqrt(mse / (var + 1e-7))')} AS score FROM rows")
def q_a5(spark, d):
    return V.rows(spark, d).select("model", "mode", *FRAME, "field", sig(vrmse(F.col("mse"), F.col("var"), EPS)).alias("score"))


@query("q_a6", "cells", f"SELECT file, trajectory, t, {S('avg(density)')} AS mean_density, " + ", ".join(f"round(avg({f}), 9) + 0.0 AS mean_{f}" for f in V.FIELDS[1:]) + " FROM cells GROUP BY file, trajectory, t")
def q_a6(spark, d):
    """Means that may cancel out are compared to nine decimals."""
    means = A.spatial_mean(V.cells(spark, d)).withColumns({f"mean_{f}": F.round(f"mean_{f}", 9) + 0.0 for f in V.FIELDS[1:]})
    return sigs(means.select(*FRAME, *(f"mean_{f}" for f in V.FIELDS)), "mean_density")


@query("q_a7", "grid", f"WITH {_PERS} SELECT file, trajectory, t, field, field_idx, {S('persistence_mse')} AS persistence_mse FROM pm")
def q_a7(spark, d):
    return sigs(A.persistence_mse(V.grid(spark, d)), "persistence_mse")


@query("q_a8", "preds", f"SELECT model, mode, file, trajectory, t, field, CASE WHEN model <> 'bias' THEN {S('v')} END AS pvar, round(v, 10) + 0.0 AS rounded FROM (SELECT model, mode, file, trajectory, t, field, {VAR('pred')} AS v FROM preds GROUP BY ALL) q")
def q_a8(spark, d):
    """A shift far above a field's spread leaves few figures of the variance, so all models are compared to ten decimals too."""
    v = A.prediction_variance(V.preds(spark, d)).withColumn("rounded", F.round("pvar", 10) + 0.0)
    return sigs(v.withColumn("pvar", F.when(F.col("model") != "bias", F.col("pvar"))), "pvar")


@query("q_a9", "rows", f"SELECT model, mode, file, trajectory, t, rollout_step, input_start, {S('avg(sqrt(mse / (var + 1e-7)))')} AS score FROM rows GROUP BY ALL")
def q_a9(spark, d):
    return sigs(A.field_mean_vrmse(V.rows(spark, d), EPS), "score")


@query("q_a10", "rows", f"SELECT model, file, trajectory, t, field, {S('sqrt(mse / (var + 1e-7))')} AS at_eps, {S('sqrt(mse / (var + 1e-5))')} AS at_fix FROM rows WHERE mode = 'rollout'")
def q_a10(spark, d):
    return V.rows(spark, d).where("mode = 'rollout'").select("model", *FRAME, "field", sig(vrmse(F.col("mse"), F.col("var"), EPS)).alias("at_eps"), sig(vrmse(F.col("mse"), F.col("var"), EPS_FIX)).alias("at_fix"))


@query("q_a11", "rows", "SELECT model, mode, file, trajectory, t, rollout_step, input_start, bool_and(coalesce(var > 1e-5, false)) AS conditioned FROM rows GROUP BY ALL")
def q_a11(spark, d):
    return A.well_conditioned(V.rows(spark, d))


@query("q_a12", "vec", f"WITH e AS (SELECT trajectory, t, unnest(embedding) AS x FROM vec) SELECT trajectory, t, {S('max(abs(CAST(x AS DOUBLE) * 1.5 - x)) / greatest(max(abs(CAST(x AS DOUBLE) * 1.5)), 1e-30)')} AS rel_diff FROM e GROUP BY ALL")
def q_a12(spark, d):
    x = V.vec(spark, d).select("trajectory", "t", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return sigs(A.relative_difference(x.withColumn("x", F.col("x") * 1.5), x, ["trajectory", "t", "i"], ["trajectory", "t"]), "rel_diff")


@query("q_a13", "preds", f"SELECT model, rollout_step, {S('max(abs(pred - target))')} AS max_abs_diff, CAST(grouping(rollout_step) AS INT) AS overall FROM preds WHERE mode = 'rollout' GROUP BY GROUPING SETS ((model, rollout_step), (model))")
def q_a13(spark, d):
    return A.max_difference(V.preds(spark, d)).withColumns({"max_abs_diff": sig(F.col("max_abs_diff")), "overall": F.col("overall").cast("int")})


@query("q_a14", "rows", f"SELECT model, mode, file, trajectory, t, field, {S('sqrt(var * (n_cells - 1) / n_cells / (var + 1e-7))')} AS baseline FROM rows")
def q_a14(spark, d):
    return A.mean_predictor(V.rows(spark, d)).select("model", "mode", *FRAME, "field", sig(F.col("baseline")).alias("baseline"))


@query("q_c1", "cells", f"WITH {_VAR} SELECT file, trajectory, t, field, {S('1e-7 / (var + 1e-7)')} AS share FROM fv")
def q_c1(spark, d):
    return A.long_variance(V.cells(spark, d)).select(*FRAME, "field", sig(floor_share(F.col("var"), EPS)).alias("share"))


@query("q_c2", "cells", f"WITH {_VAR}, s AS (SELECT *, 1e-7 / (var + 1e-7) AS share FROM fv) SELECT file, trajectory, t, field, {_BAND} AS band FROM s")
def q_c2(spark, d):
    return A.long_variance(V.cells(spark, d)).select(*FRAME, "field", band(floor_share(F.col("var"), EPS)).alias("band"))


def _report(spark, d, eps=EPS, by=("file", "field"), medians=False):
    return C.field_report(A.long_variance(V.cells(spark, d)), eps, by, medians)


@query("q_c3", "cells", f"WITH {_VAR} SELECT file, field, count(*) AS n_frames, " + ", ".join(f"{S(f'CASE WHEN bool_or(var IS NULL) THEN {_NAN} ELSE {x} END')} AS {n}" for x, n in (("min(var)", "var_min"), ("median(var)", "var_median"), ("max(var)", "var_max"), ("max(1e-7 / (var + 1e-7))", "share_worst"), ("median(1e-7 / (var + 1e-7))", "share_median"))) + " FROM fv GROUP BY file, field")
def q_c3(spark, d):
    return sigs(_report(spark, d, medians=True).select("file", "field", "n_frames", "var_min", "var_median", "var_max", "share_worst", "share_median"), "var_min", "var_median", "var_max", "share_worst", "share_median")


@query("q_c4", "cells", f"WITH {_VAR} SELECT file, field, count(*) FILTER (WHERE var <= 1e-7) AS n_at_floor, {S('count(*) FILTER (WHERE var <= 1e-7) / count(*)')} AS frac_at_floor FROM fv GROUP BY file, field")
def q_c4(spark, d):
    return sigs(_report(spark, d).select("file", "field", "n_at_floor", "frac_at_floor"), "frac_at_floor")


@query("q_c5", "cells", f"WITH {_VAR} SELECT file, field, count(*) FILTER (WHERE 1e-7 / (var + 1e-7) >= 0.9) AS n_determined FROM fv GROUP BY file, field")
def q_c5(spark, d):
    return _report(spark, d).select("file", "field", "n_determined")


@query("q_c6", "events", "WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, var_samp(value) AS var FROM events GROUP BY ALL) SELECT user_id, count(*) AS n_frames, count(*) FILTER (WHERE var <= 0) AS n_zero, count(*) FILTER (WHERE var IS NULL OR isnan(var) OR isinf(var)) AS n_undefined FROM v GROUP BY user_id")
def q_c6(spark, d):
    v = V.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.var_samp("value").alias("var"))
    return C.field_report(v, EPS, ["user_id"], medians=False).select("user_id", "n_frames", "n_zero", "n_undefined")


@query("q_c7", "cells", f"WITH {_VAR} SELECT file, field, {S('max(var) / min(var)')} AS span FROM fv GROUP BY file, field")
def q_c7(spark, d):
    return sigs(_report(spark, d, 0.0).select("file", "field", "span"), "span")


@query("q_c8", "cells", f"WITH {_VAR} SELECT file, field, {S('1 / sqrt(min(var) FILTER (WHERE var > 0))')} AS amplification FROM fv GROUP BY file, field")
def q_c8(spark, d):
    return sigs(_report(spark, d, 0.0).select("file", "field", "amplification"), "amplification")


_C9 = "CASE WHEN bool_or(var IS NULL OR isnan(var) OR isinf(var)) THEN 'undefined-denominator' WHEN min(var) <= 0 THEN 'degenerate-denominator' WHEN max(var) / min(var) >= 1e6 OR 1 / sqrt(min(var)) >= 1e6 THEN 'floorless-unbounded' ELSE 'no-floor' END"


@query("q_c9", "cells", f"WITH {_VAR} SELECT file, field, {_C9} AS band FROM fv GROUP BY file, field")
def q_c9(spark, d):
    return _report(spark, d, 0.0).select("file", "field", "band")


@query("q_c10", "rows", f"WITH m AS (SELECT model, mode, eps, avg(sqrt(mse / (var + eps))) AS score FROM rows CROSS JOIN (VALUES (1e-9), (1e-7), (1e-5)) f(eps) GROUP BY ALL) SELECT model, mode, eps, {S('score')} AS score, {S('max(CASE WHEN score > 0 THEN score END) OVER w / min(CASE WHEN score > 0 THEN score END) OVER w')} AS span FROM m WINDOW w AS (PARTITION BY model, mode)")
def q_c10(spark, d):
    return sigs(C.sweep_scores(V.rows(spark, d), [1e-9, 1e-7, 1e-5], ["model", "mode"]), "score", "span")


@query("q_c11", "cells", f"WITH {_VAR}, r AS (SELECT field, sqrt((var + 1e-5) / (var + 1e-7)) AS r FROM fv WHERE var IS NOT NULL) SELECT field, {S('min(r)')} AS least, {S('median(r)')} AS median, {S('max(r)')} AS most, count(*) FILTER (WHERE isnan(r) OR isinf(r)) AS n_unbounded FROM r GROUP BY field")
def q_c11(spark, d):
    return sigs(C.sweep_bound(A.long_variance(V.cells(spark, d)), EPS, EPS_FIX), "least", "median", "most")


@query("q_c12", "cells", f"WITH {_VAR}, r AS (SELECT field, field_idx, CASE WHEN NOT bool_or(var IS NULL) THEN max(1e-7 / (var + 1e-7)) END AS s FROM fv GROUP BY ALL) SELECT field, {S(f'coalesce(s, {_NAN})')} AS share_worst FROM r ORDER BY coalesce(nullif(s, 0), -1) DESC, field_idx LIMIT 1")
def q_c12(spark, d):
    return C.least_conditioned(_report(spark, d, by=("field", "field_idx"))).select("field", sig(F.col("share_worst")).alias("share_worst"))


@query("q_c13", "cells", f"WITH {_VAR}, r AS (SELECT field, CASE WHEN NOT bool_or(var IS NULL) THEN max(1e-7 / (var + 1e-7)) END AS s, bool_or(var IS NULL) AS u FROM fv GROUP BY ALL) SELECT CASE WHEN bool_or(u) THEN 'SCREEN UNDEFINED' WHEN max(s) >= 0.9 THEN 'SCREEN POSITIVE' WHEN max(s) >= 0.5 THEN 'SCREEN BORDERLINE' ELSE 'SCREEN NEGATIVE' END AS verdict, {S('max(s)')} AS worst_share, count(*) AS n_fields FROM r")
def q_c13(spark, d):
    return sigs(C.verdict(_report(spark, d, by=("field",)), EPS), "worst_share")


@query("q_c14", "cells", f"WITH {_VAR}, r AS (SELECT field, {_C9} AS band, max(var) AS hi, min(var) FILTER (WHERE var > 0) AS lo FROM fv GROUP BY field) SELECT field, CASE WHEN band = 'no-floor' AND (SELECT max(hi) / min(lo) FROM r) >= 1e6 THEN 'floorless-unbounded' ELSE band END AS band FROM r")
def q_c14(spark, d):
    return C.rescued(_report(spark, d, 0.0, ("field",))).select("field", "band")


@query("q_c15", "cells", f"WITH {_VAR}, s AS (SELECT field, CASE WHEN NOT bool_or(var IS NULL) THEN max(1e-7 / (var + 1e-7)) END AS share FROM fv GROUP BY field), b AS (SELECT {_BAND} AS band FROM s) SELECT concat_ws(',', CASE WHEN bool_or(band = 'floor-determined') THEN 'positive' END, CASE WHEN bool_or(band = 'undefined') THEN 'undefined' END) AS reasons, NOT bool_or(band IN ('floor-determined', 'undefined')) AS clean FROM b")
def q_c15(spark, d):
    return C.clean_gate(_report(spark, d, by=("field",)))


@query("q_c16", "cells", "WITH f AS (" + " UNION ALL ".join(f"SELECT file, trajectory, t, '{f}' AS field, 1e-7 / (var_pop({f}) + 1e-7) AS a, 1e-7 / (avg({f} * {f}) + 1e-7) AS b FROM cells GROUP BY ALL" for f in FIELDS) + f") SELECT file, trajectory, t, field, {_BAND.replace('share', 'a')} AS by_variance, {_BAND.replace('share', 'b')} AS by_rms FROM f")
def q_c16(spark, d):
    both = V.cells(spark, d).groupBy(*FRAME).agg(*(g(f).alias(f"{n}_{f}") for f in FIELDS for n, g in (("v", F.var_pop), ("r", lambda c: F.avg(F.col(c) * F.col(c))))))
    each = F.array(*(F.struct(F.lit(f).alias("field"), band(floor_share(F.col(f"v_{f}"), EPS)).alias("by_variance"), band(floor_share(F.col(f"r_{f}"), EPS)).alias("by_rms")) for f in FIELDS))
    return both.select(*FRAME, F.inline(each))


@query("q_c17", "rows", f"SELECT model, field, {S('max(sqrt(mse / (var + 1e-7)) / sqrt(mse))')} AS amplification, bool_and(sqrt(mse / (var + 1e-7)) / sqrt(mse) <= 1 / sqrt(1e-7) * (1 + 1e-12)) AS bounded FROM rows WHERE mse > 0 AND var IS NOT NULL GROUP BY ALL")
def q_c17(spark, d):
    a = safe_div(vrmse(F.col("mse"), F.col("var"), EPS), F.sqrt("mse"))
    return sigs(V.rows(spark, d).where("mse > 0 and var is not null").groupBy("model", "field").agg(F.max(a).alias("amplification"), F.bool_and(a <= EPS**-0.5 * (1 + 1e-12)).alias("bounded")), "amplification")


@query("q_c18", "grid", "WITH s AS (SELECT file, trajectory, field, site, count(*) FILTER (WHERE x <> 0) AS nz, arg_min(x, t) AS a, arg_max(x, t) AS b FROM grid GROUP BY ALL) SELECT file, trajectory, field, sum(nz) = 0 AS all_zero, bool_and(abs(b - a) <= 1e-4) AS returns FROM s GROUP BY ALL")
def q_c18(spark, d):
    return C.static_fields(V.grid(spark, d), 1e-4)


def _census(spark, d):
    return M.component_census(A.long_variance(V.cells(spark, d)))


_MC = "mc AS (SELECT file, field, min(var) AS var_min, max(var) AS var_max, avg(var) AS var_mean, avg(CAST(var <= 1e-7 AS INT)) AS frac_le_eps, avg(CAST(var <= 1e-5 AS INT)) AS frac_le_fix, count(*) AS n_frames, min(t) AS t_first, max(t) AS t_last FROM fv GROUP BY file, field)"
_MCS = ("var_min", "var_max", "var_mean", "frac_le_eps", "frac_le_fix")


@query("q_m1", "cells", f"WITH {_VAR}, {_MC} SELECT file, field, n_frames, t_first, t_last, " + ", ".join(f"{S(c)} AS {c}" for c in _MCS) + " FROM mc")
def q_m1(spark, d):
    return sigs(_census(spark, d), *_MCS)


@query("q_m2", "cells", f"WITH {_VAR}, k AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY trajectory) AS k FROM fv) SELECT file, trajectory, field, count(*) AS n_frames, {S('min(var)')} AS var_min, {S('max(var)')} AS var_max FROM k WHERE k <= 1 GROUP BY ALL")
def q_m2(spark, d):
    from pyspark.sql import Window

    var = A.long_variance(V.cells(spark, d))
    first = var.select("file", "trajectory").distinct().withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("trajectory"))).where("k <= 1")
    return sigs(M.component_census(var.join(first, ["file", "trajectory"], "left_semi"), ["file", "trajectory", "field"]).select("file", "trajectory", "field", "n_frames", "var_min", "var_max"), "var_min", "var_max")


_M3 = "ta AS (SELECT file, trajectory, field, count(*) FILTER (WHERE var <= 1e-7) AS n_le, max(CASE WHEN var <= 1e-7 THEN t END) AS last_t_le, min(var) AS var_min, max(CASE WHEN t = 4 THEN var END) AS var_t4, max(CASE WHEN t = 33 THEN var END) AS var_t33, first(var ORDER BY t DESC) AS var_final FROM fv GROUP BY ALL)"


@query("q_m3", "cells", f"WITH {_VAR}, {_M3} SELECT file, trajectory, field, n_le, last_t_le, " + ", ".join(f"{S(c)} AS {c}" for c in ("var_min", "var_t4", "var_t33", "var_final")) + " FROM ta")
def q_m3(spark, d):
    return sigs(M.trajectory_audit(A.long_variance(V.cells(spark, d))), "var_min", "var_t4", "var_t33", "var_final")


@query("q_m4", "cells", f"WITH {_VAR}, {_M3} SELECT file, trajectory, field, n_le = coalesce(last_t_le, -1) + 1 AS contiguous FROM ta")
def q_m4(spark, d):
    return M.trajectory_audit(A.long_variance(V.cells(spark, d))).select("file", "trajectory", "field", (F.col("n_le") == F.coalesce("last_t_le", F.lit(-1)) + 1).alias("contiguous"))


@query("q_m5", "cells", f"WITH {_VAR}, a AS (SELECT file, trajectory, field, avg(CAST(var <= 1e-5 AS INT)) AS share FROM fv WHERE field IN ('vx', 'vy') AND t BETWEEN 4 AND 33 GROUP BY ALL), b AS (SELECT file, trajectory, min(share) AS share FROM a GROUP BY ALL) SELECT file, {S('avg(share)')} AS mean, {S('min(share)')} AS least, {S('max(share)')} AS most, count(*) FILTER (WHERE share = 1) AS n_wholly, count(*) AS n_trajectories FROM b GROUP BY file")
def q_m5(spark, d):
    return sigs(M.window_coverage(A.long_variance(V.cells(spark, d)), ["vx", "vy"], 4, 33), "mean", "least", "most")


_M6 = "ru AS (SELECT file, field, var_min AS min_var, frac_le_eps, frac_le_fix FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY var_min, field) AS r FROM mc) q WHERE r = 1)"


@query("q_m6", "cells", f"WITH {_VAR}, {_MC}, {_M6} SELECT file, field, {S('min_var')} AS min_var, {S('frac_le_eps')} AS frac_le_eps, {S('frac_le_fix')} AS frac_le_fix FROM ru")
def q_m6(spark, d):
    return sigs(M.dataset_rollup(_census(spark, d)), "min_var", "frac_le_eps", "frac_le_fix")


def _mapped(spark, d):
    # the published status of a file: whether its mean price is above that of all files
    c = V.cells(spark, d)
    mean = c.agg(F.avg("density").alias("m"))
    status = c.groupBy("file").agg(F.avg("density").alias("x")).crossJoin(F.broadcast(mean)).select("file", F.when(F.col("x") > F.col("m"), "yes").otherwise("no").alias("gt10")).where("file <> 'R'")
    return M.categories(M.dataset_rollup(_census(spark, d)), status)


_M7 = "st AS (SELECT file, CASE WHEN avg(density) > (SELECT avg(density) FROM cells) THEN 'yes' ELSE 'no' END AS gt10 FROM cells WHERE file <> 'R' GROUP BY file), mp AS (SELECT ru.file, field, min_var, coalesce(gt10, '?') AS gt10, CASE WHEN min_var <= 1e-7 THEN 'severe' WHEN min_var <= 1e-5 THEN 'susceptible' ELSE 'healthy' END AS susceptibility, CASE WHEN min_var <= 1e-7 AND gt10 = 'yes' THEN 'library_floored' WHEN min_var <= 1e-7 THEN 'library_floored_no_headline' WHEN min_var <= 1e-5 AND gt10 = 'yes' THEN 'floor_sensitive_gt10' WHEN min_var <= 1e-5 THEN 'floor_sensitive_no_gt10' WHEN gt10 = 'yes' THEN 'no_susceptibility_gt10' ELSE 'well_conditioned' END AS category FROM ru LEFT JOIN st ON st.file = ru.file)"


@query("q_m7", "cells", f"WITH {_VAR}, {_MC}, {_M6}, {_M7} SELECT file, field, gt10, susceptibility, category FROM mp")
def q_m7(spark, d):
    return _mapped(spark, d).select("file", "field", "gt10", "susceptibility", "category")


@query("q_m8", "cells", f"WITH {_VAR}, {_MC}, {_M6} SELECT file, {S('1e-7 / (min_var + 1e-7)')} AS floor_share FROM ru")
def q_m8(spark, d):
    return _mapped(spark, d).select("file", "floor_share")


@query("q_m9", "cells", f"WITH {_VAR}, {_MC}, {_M6}, {_M7} SELECT file, category, CAST(row_number() OVER (ORDER BY list_position(['triggered_audited','library_floored','library_floored_no_headline','floor_sensitive_gt10','floor_sensitive_no_gt10','no_susceptibility_gt10','well_conditioned'], category), min_var, file) AS INT) AS place FROM mp")
def q_m9(spark, d):
    return M.map_order(_mapped(spark, d)).select("file", "category", "place")


@query("q_m11", "grid", f"WITH {_PERS}, {_GVAR} SELECT file, trajectory, t, {S('avg(sqrt(persistence_mse / (var + 1e-7)))')} AS score FROM pm JOIN gv USING (file, trajectory, t, field) WHERE persistence_mse IS NOT NULL GROUP BY ALL")
def q_m11(spark, d):
    return sigs(M.persistence_curve(A.frame_stats(V.grid(spark, d))), "score")


_A, _B = "sqrt(persistence_mse / (var + 1e-7))", "sqrt(persistence_mse / (var + 1e-5))"


@query("q_m12", "grid", f"WITH {_PERS}, {_GVAR}, j AS (SELECT w.label, field, var, persistence_mse FROM pm JOIN gv USING (file, trajectory, t, field) JOIN (VALUES ('4:33', 4, 33), ('6:12', 6, 12), ('13:30', 13, 30), ('34:82', 34, 82)) w(label, lo, hi) ON t BETWEEN lo AND hi) SELECT label, field, {S('avg(CAST(var <= 1e-7 AS INT))')} AS frac_le_eps, {S(f'avg({_A} / {_B})')} AS ratio, {S(f'max({_A})')} AS max_eps, {S(f'avg({_A})')} AS mean_eps, {S(f'max({_B})')} AS max_fix, {S(f'avg({_B})')} AS mean_fix, {S('min(var)')} AS var_min, {S('median(var)')} AS var_median, {S('max(var)')} AS var_max, count(*) AS n FROM j GROUP BY ALL")
def q_m12(spark, d):
    wins = spark.createDataFrame([("4:33", 4, 33), ("6:12", 6, 12), ("13:30", 13, 30), ("34:82", 34, 82)], "label string, lo int, hi int")
    out = M.window_table(A.frame_stats(V.grid(spark, d)), wins)
    return sigs(out, *(c for c in out.columns if c not in ("label", "field", "n")))


@query("q_m13", "cells", f"WITH {_VAR} SELECT file, trajectory, {S('max(CASE WHEN t = 4 AND field = ' + chr(39) + 'vx' + chr(39) + ' THEN var END)')} AS quiet_t4, {S('min(CASE WHEN field = ' + chr(39) + 'vx' + chr(39) + ' THEN var END)')} AS quiet_min, {S('min(CASE WHEN field = ' + chr(39) + 'density' + chr(39) + ' THEN var END)')} AS healthy_min FROM fv GROUP BY file, trajectory")
def q_m13(spark, d):
    v = A.long_variance(V.cells(spark, d))
    of = lambda f, c=None: F.when((F.col("field") == f) & (F.lit(True) if c is None else c), F.col("var"))
    return sigs(v.groupBy("file", "trajectory").agg(F.max(of("vx", F.col("t") == 4)).alias("quiet_t4"), F.min(of("vx")).alias("quiet_min"), F.min(of("density")).alias("healthy_min")), "quiet_t4", "quiet_min", "healthy_min")
