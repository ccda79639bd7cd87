"""Registered queries: score aggregation (W) and the joins, set operations and sorts behind it (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, safe_div, sig, two_sided_p, vrmse
from fieldgauge.operators import frames as A
from fieldgauge.operators import records as Q
from fieldgauge.operators import scores as W
from fieldgauge.plans.queries_frames import _GVAR, _PERS, gvar, sigs
from fieldgauge.plans.registry import S, query
from fieldgauge.sources import views as V
from fieldgauge.sources.views import FRAME

_WIN = "win AS (SELECT * FROM (VALUES ('6-12', 6, 12), ('13-30', 13, 30)) w(label, lo, hi))"
_EPS = "(VALUES (1e-7), (1e-5)) f(eps)"
_RS = f"rs AS (SELECT model, file, trajectory, rollout_step, eps, avg(sqrt(mse / (var + eps))) AS score FROM rows CROSS JOIN {_EPS} WHERE mode = 'rollout' GROUP BY ALL)"
_PT = f"{_RS}, {_WIN}, pt AS (SELECT model, file, trajectory, label, eps, avg(score) AS score FROM rs JOIN win ON rollout_step BETWEEN lo AND hi GROUP BY ALL)"
_OS = f"os AS (SELECT model, file, trajectory, input_start AS x, eps, avg(sqrt(mse / (var + eps))) AS y, min(var) AS min_var FROM rows CROSS JOIN {_EPS} WHERE mode = 'onestep' GROUP BY ALL)"


def _roll(spark, d, floors=(EPS, EPS_FIX)):
    return W.scored(V.rows(spark, d), list(floors), "rollout")


def _per(spark, d):
    return W.per_trajectory_windows(_roll(spark, d), W.windows(spark))


def _starts(spark, d):
    return W.starts(V.rows(spark, d), [EPS, EPS_FIX])


@query("q_w1", "rows", f"WITH r AS (SELECT model, file, trajectory, input_start, avg(sqrt(mse / (var + 1e-7))) AS y, bool_and(coalesce(var > 1e-5, false)) AS c FROM rows WHERE mode = 'onestep' GROUP BY ALL) SELECT model, file, trajectory, count(*) AS n, string_agg(CAST(input_start AS VARCHAR) || ':' || CAST(c AS VARCHAR), ',' ORDER BY input_start) AS curve, {S('sum(y)')} AS total FROM r GROUP BY ALL")
def q_w1(spark, d):
    r = V.rows(spark, d).where("mode = 'onestep'").groupBy("model", "file", "trajectory", "input_start").agg(F.avg(vrmse(F.col("mse"), F.col("var"), EPS)).alias("y"), F.bool_and(F.coalesce(F.col("var") > EPS_FIX, F.lit(False))).alias("c"))
    points = F.array_sort(F.collect_list(F.struct("input_start", "c")))
    return sigs(r.groupBy("model", "file", "trajectory").agg(F.count("*").alias("n"), F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["input_start"].cast("string"), p["c"].cast("string"))), ",").alias("curve"), F.sum("y").alias("total")), "total")


@query("q_w2", "rows", f"WITH {_OS} SELECT model, eps, {S('avg(y)')} AS mean, count(*) AS n FROM os GROUP BY ALL")
def q_w2(spark, d):
    return sigs(_starts(spark, d).groupBy("model", "eps").agg(F.avg("y").alias("mean"), F.count("*").alias("n")), "mean")


@query(
    "q_w3",
    "curve",
    f"""WITH p AS (SELECT trajectory, x, avg(y) AS y FROM curve GROUP BY ALL), g AS (SELECT trajectory, unnest(range(0, 115)) AS g FROM (SELECT DISTINCT trajectory FROM p) q),
b AS (SELECT g.trajectory, g.g, max(p.x) FILTER (WHERE p.x <= g.g) AS xa, min(p.x) FILTER (WHERE p.x >= g.g) AS xb FROM g JOIN p ON p.trajectory = g.trajectory GROUP BY ALL),
v AS (SELECT b.trajectory, b.g, CASE WHEN xa IS NULL THEN pb.y WHEN xb IS NULL OR xa = xb THEN pa.y ELSE pa.y + (pb.y - pa.y) * (b.g - xa) / (xb - xa) END AS y FROM b LEFT JOIN p pa ON pa.trajectory = b.trajectory AND pa.x = xa LEFT JOIN p pb ON pb.trajectory = b.trajectory AND pb.x = xb)
SELECT trajectory, {S('avg(y)')} AS mean, count(*) AS n_grid FROM v GROUP BY trajectory""",
)
def q_w3(spark, d):
    p = V.curve(spark, d).groupBy("trajectory", "x").agg(F.avg("y").alias("y"))
    return sigs(W.interpolated_mean(p, 0, 114, ["trajectory"]), "mean")


@query("q_w4", "rows", f"WITH r AS (SELECT model, file, trajectory, input_start, avg(sqrt(mse / (var + 1e-7))) AS y, bool_and(coalesce(var > 1e-5, false)) AS c FROM rows WHERE mode = 'onestep' GROUP BY ALL) SELECT model, {S('avg(y) FILTER (WHERE c)')} AS well, {S('avg(y) FILTER (WHERE NOT c)')} AS ill, count(*) FILTER (WHERE c) AS n_well, count(*) FILTER (WHERE NOT c) AS n_ill FROM r GROUP BY model")
def q_w4(spark, d):
    r = V.rows(spark, d).where("mode = 'onestep'").groupBy("model", "file", "trajectory", "input_start").agg(F.avg(vrmse(F.col("mse"), F.col("var"), EPS)).alias("y"), F.bool_and(F.coalesce(F.col("var") > EPS_FIX, F.lit(False))).alias("c"))
    return sigs(r.groupBy("model").agg(F.avg(F.when(F.col("c"), F.col("y"))).alias("well"), F.avg(F.when(~F.col("c"), F.col("y"))).alias("ill"), F.count_if("c").alias("n_well"), F.count_if(~F.col("c")).alias("n_ill")), "well", "ill")


@query("q_w5", "rows", f"WITH {_PT} SELECT model, label, eps, {S('avg(score)')} AS score, count(*) AS n_trajectories FROM pt GROUP BY ALL")
def q_w5(spark, d):
    return sigs(W.window_means(_roll(spark, d), W.windows(spark)), "score")


@query("q_w6", "rows", f"WITH {_PT.replace('FROM rows', 'FROM (SELECT * FROM rows WHERE field <> ' + chr(39) + 'density' + chr(39) + ') q')} SELECT model, label, eps, {S('avg(score)')} AS score, count(*) AS n_trajectories FROM pt GROUP BY ALL")
def q_w6(spark, d):
    return sigs(W.window_means(W.scored(V.rows(spark, d).where("field <> 'density'"), [EPS, EPS_FIX], "rollout"), W.windows(spark)), "score")


@query("q_w7", "rows", f"WITH {_WIN}, r AS (SELECT model, file, trajectory, rollout_step, avg(sqrt(mse / (var + 1e-7))) AS score, bool_and(coalesce(var > 1e-7, false)) AS good FROM rows WHERE mode = 'rollout' GROUP BY ALL) SELECT model, label, {S('avg(score) FILTER (WHERE good)')} AS score, count(*) FILTER (WHERE good) AS n_used, count(*) AS n_total FROM r JOIN win ON rollout_step BETWEEN lo AND hi GROUP BY ALL")
def q_w7(spark, d):
    return sigs(W.conditioned_windows(V.rows(spark, d), W.windows(spark), EPS, EPS), "score")


@query("q_w8", "rows", f"SELECT model, file, trajectory, min(CASE WHEN mse > 0.001 OR isnan(mse) OR isinf(mse) THEN rollout_step END) AS first_bad_step, {S('max(mse)')} AS max_mse FROM rows WHERE mode = 'rollout' GROUP BY ALL")
def q_w8(spark, d):
    """The limit is set low: no forecaster of these tables diverges beyond a million."""
    return sigs(W.first_divergent_step(V.rows(spark, d), 0.001), "max_mse")


@query("q_w9", "rows", f"WITH {_PT} SELECT model, file, trajectory, label, eps, {S('score')} AS score FROM pt")
def q_w9(spark, d):
    return sigs(_per(spark, d), "score")


@query("q_w10", "rows", (f"WITH {_PT} SELECT model, label, eps, {S('arg_max(score, file || trajectory)')} AS last, {S('avg(score)')} AS all, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, {S('arg_max(score, file || trajectory) / avg(score)')} AS ratio FROM pt GROUP BY ALL UNION ALL SELECT model, 'step ' || rollout_step, eps, {S('arg_max_null(score, file || trajectory)')}, {S('avg(score)')}, {S('min(score)')}, {S('max(score)')}, {S('arg_max_null(score, file || trajectory) / avg(score)')} FROM rs GROUP BY ALL").replace(" AS all", ' AS "all"'))
def q_w10(spark, d):
    """Window ratios of the last trajectory to all, and the curves by step."""
    roll = _roll(spark, d)
    steps = W.last_trajectory_curves(roll).withColumn("label", F.concat(F.lit("step "), F.col("rollout_step").cast("string"))).drop("rollout_step")
    return sigs(W.last_trajectory_counterfactual(roll, W.windows(spark)).unionByName(steps, allowMissingColumns=True), "last", "all", "least", "most", "ratio")


_TZ = "tz AS (SELECT model, eps, file, trajectory, count(*) AS n, avg(y) AS plain, CASE WHEN max(x) > min(x) THEN sum((y + y2) / 2 * (x2 - x)) / (max(x) - min(x)) ELSE avg(y) END AS weighted FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM os WINDOW w AS (PARTITION BY model, eps, file, trajectory ORDER BY x)) q GROUP BY ALL)"


@query("q_w11", "rows", f"WITH {_OS}, {_TZ} SELECT model, eps, {S('avg(weighted)')} AS weighted, count(*) AS n FROM tz WHERE n > 1 GROUP BY ALL")
def q_w11(spark, d):
    per = W.trapezoid(_starts(spark, d), ["model", "eps", "file", "trajectory"]).where("n > 1")
    return sigs(per.groupBy("model", "eps").agg(F.avg("weighted").alias("weighted"), F.count("*").alias("n")), "weighted")


@query("q_w12", "curve", f"WITH p AS (SELECT trajectory, model, x, avg(y) AS y FROM curve GROUP BY ALL), s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY trajectory, model ORDER BY x)) SELECT trajectory, model, {S('CASE WHEN max(x) > min(x) THEN sum((y + y2) / 2 * (x2 - x)) / (max(x) - min(x)) ELSE avg(y) END', 4)} AS weighted, {S('avg(y)', 4)} AS plain, count(*) AS n FROM s GROUP BY ALL")
def q_w12(spark, d):
    p = V.curve(spark, d).groupBy("trajectory", "model", "x").agg(F.avg("y").alias("y"))
    return W.trapezoid(p, ["trajectory", "model"]).withColumns({c: sig(F.col(c), 4) for c in ("weighted", "plain")})


_PH = "ph AS (SELECT model, eps, file, trajectory, quiet, count(*) AS n, avg(y) AS plain, CASE WHEN max(x) > min(x) THEN sum((y + y2) / 2 * (x2 - x)) / (max(x) - min(x)) ELSE avg(y) END AS weighted FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT *, min_var <= 1e-5 AS quiet FROM os WHERE min_var IS NOT NULL) o WINDOW w AS (PARTITION BY model, eps, file, trajectory, quiet ORDER BY x)) q GROUP BY ALL)"


@query("q_w13", "rows", f"WITH {_OS}, {_PH} SELECT model, eps, " + ", ".join(f"{S(f'avg({c}) FILTER (WHERE {q})')} AS {n}_{c}" for n, q in (("quiescent", "quiet"), ("developed", "NOT quiet")) for c in ("weighted", "plain")) + f", CAST(sum(CASE WHEN quiet THEN n ELSE 0 END) AS BIGINT) AS n_quiescent, CAST(sum(CASE WHEN quiet THEN 0 ELSE n END) AS BIGINT) AS n_developed, {S('avg(weighted) FILTER (WHERE quiet) / avg(weighted) FILTER (WHERE NOT quiet)')} AS ratio FROM ph GROUP BY ALL")
def q_w13(spark, d):
    return sigs(W.phase_split(_starts(spark, d)), "quiescent_weighted", "quiescent_plain", "developed_weighted", "developed_plain", "ratio")


_QF = "qf AS (SELECT file, count(*) AS n_starts, count(*) FILTER (WHERE v <= 1e-5) AS n_quiescent, avg(CAST(v <= 1e-5 AS INT)) AS quiescent_fraction, min(v) AS min_field_variance FROM (SELECT file, trajectory, input_start, min(var) AS v FROM rows WHERE mode = 'onestep' AND model <> 'persistence' GROUP BY ALL) q GROUP BY file)"


@query("q_w14", "rows", f"WITH {_QF} SELECT file, n_starts, n_quiescent, {S('quiescent_fraction')} AS quiescent_fraction, {S('min_field_variance')} AS min_field_variance FROM qf")
def q_w14(spark, d):
    # persistence has no forecast where a frame is missing, so its starts are others
    return sigs(W.quiescent_fraction(V.rows(spark, d).where("model <> 'persistence'")), "quiescent_fraction", "min_field_variance")


@query("q_w15", "rows", f"SELECT model, field, {S('avg(sqrt(mse / (var + 1e-7)))')} AS score, count(*) AS n FROM rows WHERE mode = 'rollout' AND rollout_step BETWEEN 6 AND 12 GROUP BY ALL")
def q_w15(spark, d):
    return sigs(V.rows(spark, d).where("mode = 'rollout' and rollout_step between 6 and 12").groupBy("model", "field").agg(F.avg(vrmse(F.col("mse"), F.col("var"), EPS)).alias("score"), F.count("*").alias("n")), "score")


@query("q_w16", "rows", f"WITH {_PT}, c AS (SELECT model, label, eps, avg(score) AS score FROM pt GROUP BY ALL) SELECT eps, count(*) FILTER (WHERE score > 10) AS n_above, count(*) AS n, coalesce(string_agg(model || '/' || label, ',' ORDER BY model || '/' || label) FILTER (WHERE score <= 10), '') AS not_above FROM c GROUP BY eps")
def q_w16(spark, d):
    return W.crossings(W.window_means(_roll(spark, d), W.windows(spark)))


@query("q_w17", "rows", f"WITH {_PT}, c AS (SELECT file, model, label, eps, avg(score) AS score FROM pt GROUP BY ALL) SELECT file, eps, count(*) FILTER (WHERE score > 10) AS n_above, bool_and(score <= 10) AS none_above, {S('max(score)')} AS most FROM c GROUP BY file, eps")
def q_w17(spark, d):
    c = _per(spark, d).groupBy("file", "model", "label", "eps").agg(F.avg("score").alias("score"))
    return sigs(c.groupBy("file", "eps").agg(F.count_if(F.col("score") > 10).alias("n_above"), F.bool_and(F.col("score") <= 10).alias("none_above"), F.max("score").alias("most")), "most")


_ST = "sx AS (SELECT model, c.trajectory, c.file, n_above, n, predictor FROM (SELECT model, file, trajectory, count(*) FILTER (WHERE score > 10) AS n_above, count(*) AS n FROM pt WHERE eps = 1e-7 GROUP BY ALL) c JOIN (SELECT file, trajectory, avg(CAST(v <= 1e-5 AS INT)) AS predictor FROM (SELECT file, trajectory, input_start, min(var) AS v FROM rows WHERE mode = 'onestep' GROUP BY ALL) q GROUP BY ALL) p USING (file, trajectory))"


def _strata(spark, d):
    rows = V.rows(spark, d)
    c = _per(spark, d).where(F.col("eps") == EPS).groupBy("model", "file", "trajectory").agg(F.count_if(F.col("score") > 10).alias("n_above"), F.count("*").alias("n"), F.avg("score").alias("score"))
    low = rows.where("mode = 'onestep'").groupBy("file", "trajectory", "input_start").agg(F.min("var").alias("v"))
    return c.join(low.groupBy("file", "trajectory").agg(F.avg((F.col("v") <= EPS_FIX).cast("double")).alias("predictor")), ["file", "trajectory"])


@query("q_w18", "rows", f"WITH {_PT}, {_ST} SELECT model, {S('max(predictor) FILTER (WHERE n_above = 0)')} AS max_never, {S('min(predictor) FILTER (WHERE n_above = n)')} AS min_always, coalesce(max(predictor) FILTER (WHERE n_above = 0) < min(predictor) FILTER (WHERE n_above = n), false) AS separates, count(*) AS n_strata FROM sx GROUP BY model")
def q_w18(spark, d):
    return sigs(W.separation(_strata(spark, d), ["model"]), "max_never", "min_always")


_DAY = "dy AS (SELECT event_type AS model, user_id, count(*) AS a, sum(value) AS b FROM events GROUP BY ALL)"


def _daily(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("model"), "user_id").agg(F.count("*").alias("a"), F.sum("value").alias("b"))


@query("q_w19", "events", f"WITH {_DAY} SELECT model, {S('corr(a, b)')} AS r, count(*) AS n FROM dy GROUP BY model")
def q_w19(spark, d):
    return sigs(_daily(spark, d).groupBy("model").agg(F.corr("a", "b").alias("r"), F.count("*").alias("n")), "r")


_RK = "rk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY a) + (count(*) OVER (PARTITION BY model, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY model ORDER BY b) + (count(*) OVER (PARTITION BY model, b) - 1) / 2 AS rb FROM dy)"


@query("q_w20", "events", f"WITH {_DAY}, {_RK} SELECT model, {S('corr(ra, rb)')} AS rho, count(*) AS n FROM rk GROUP BY model")
def q_w20(spark, d):
    return sigs(W.midranks(_daily(spark, d), ["a", "b"], ["model"]).groupBy("model").agg(F.corr("rank_a", "rank_b").alias("rho"), F.count("*").alias("n")), "rho")


@query(
    "q_w21",
    "cells",
    f"""WITH c AS (SELECT file, t % 7 AS k, corr(density, site) AS r, count(DISTINCT t) AS n FROM cells GROUP BY ALL), a AS (SELECT *, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) AS th FROM c),
s AS (SELECT a.*, (SELECT coalesce(sum(p), 0) FROM (SELECT product(CASE WHEN a.df % 2 = 0 THEN (2 * j - 1) / (2 * j) ELSE (2 * j) / (2 * j + 1) END * cos(a.th) * cos(a.th)) AS p FROM (SELECT unnest(range(1, 60)) AS i) i, (SELECT unnest(range(1, 60)) AS j) j WHERE j <= i AND i <= floor((a.df - 2) / 2) GROUP BY i) q) AS rest FROM a)
SELECT file, k, {S('CASE WHEN df % 2 = 0 THEN 1 - sin(th) * (1 + rest) ELSE 1 - 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * (1 + rest) ELSE 0 END) END', 5)} AS p FROM s""",
)
def q_w21(spark, d):
    c = V.cells(spark, d).groupBy("file", (F.col("t") % 7).alias("k")).agg(F.corr("density", "site").alias("r"), F.countDistinct("t").alias("n"))
    return c.select("file", "k", sig(two_sided_p(F.col("r"), F.col("n") - 2), 5).alias("p"))


@query("q_w22", "rows", "WITH a AS (SELECT DISTINCT file, trajectory FROM rows WHERE mode = 'rollout' AND var <= 1e-7), b AS (SELECT DISTINCT file, trajectory FROM rows WHERE mode = 'onestep' AND var > 1e-2) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) q) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) q) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) q) AS n_only_a, (SELECT count(DISTINCT file) FROM rows) AS n_files")
def q_w22(spark, d):
    return W.set_sizes(V.rows(spark, d), ["file", "trajectory"], "mode = 'rollout' and var <= 1e-7", "mode = 'onestep' and var > 1e-2", distinct="file")


@query("q_w23", "rows", f"WITH {_OS}, {_TZ}, m AS (SELECT model, eps, avg(weighted) FILTER (WHERE file = 'A') AS narrow, avg(weighted) AS broad FROM tz WHERE n > 1 GROUP BY ALL) SELECT model, eps, {S('narrow')} AS narrow, {S('broad')} AS broad, {S('narrow / broad')} AS ratio FROM m")
def q_w23(spark, d):
    per = W.trapezoid(_starts(spark, d), ["model", "eps", "file", "trajectory"]).where("n > 1")
    m = per.groupBy("model", "eps").agg(F.avg(F.when(F.col("file") == "A", F.col("weighted"))).alias("narrow"), F.avg("weighted").alias("broad"))
    return sigs(m.withColumn("ratio", safe_div(F.col("narrow"), F.col("broad"))), "narrow", "broad", "ratio")


@query("q_w24", "rows", f"WITH {_PT}, c AS (SELECT model, label, eps, avg(score) AS score FROM pt GROUP BY ALL) SELECT a.model, a.label, {S('a.score / b.score')} AS ratio FROM c a JOIN c b ON b.model = a.model AND b.label = a.label AND b.eps = 1e-5 WHERE a.eps = 1e-7")
def q_w24(spark, d):
    """The score at the larger floor stands for the published one."""
    c = W.window_means(_roll(spark, d), W.windows(spark))
    published = c.where(F.col("eps") == EPS_FIX).select("model", "label", F.col("score").alias("published"))
    return c.where(F.col("eps") == EPS).join(published, ["model", "label"]).select("model", "label", sig(safe_div(F.col("score"), F.col("published"))).alias("ratio"))


@query("q_w25", "rows", f"WITH {_PT}, b AS (SELECT file, trajectory, rollout_step, avg(sqrt(var * (n_cells - 1) / n_cells / (var + 1e-7))) AS b FROM rows WHERE mode = 'rollout' AND model = 'zero' GROUP BY ALL), bw AS (SELECT label, avg(b) AS b FROM (SELECT file, trajectory, label, avg(b) AS b FROM b JOIN win ON rollout_step BETWEEN lo AND hi GROUP BY ALL) q GROUP BY label), m AS (SELECT model, label, avg(score) AS s FROM pt WHERE eps = 1e-7 GROUP BY ALL) SELECT model, m.label, {S('b')} AS baseline, {S('s / b')} AS ratio FROM m JOIN bw ON bw.label = m.label")
def q_w25(spark, d):
    rows = V.rows(spark, d)
    base = A.mean_predictor(rows.where("mode = 'rollout' and model = 'zero'")).groupBy("file", "trajectory", "rollout_step").agg(F.avg("baseline").alias("score")).withColumn("eps", F.lit(EPS))
    base = W.window_means(base, W.windows(spark), []).select("label", F.col("score").alias("baseline"))
    m = W.window_means(_roll(spark, d, [EPS]), W.windows(spark))
    return sigs(m.join(F.broadcast(base), "label").select("model", "label", "baseline", safe_div(F.col("score"), F.col("baseline")).alias("ratio")), "baseline", "ratio")


@query("q_w26", "rows", f"WITH {_WIN}, rs AS (SELECT model, file, trajectory, rollout_step, eps, avg(sqrt(mse / (var + eps))) AS score FROM rows CROSS JOIN (VALUES (0e0), (1e-9), (1e-7), (1e-5)) f(eps) WHERE mode = 'rollout' GROUP BY ALL), pt AS (SELECT model, file, trajectory, label, eps, avg(score) AS score FROM rs JOIN win ON rollout_step BETWEEN lo AND hi GROUP BY ALL) SELECT model, label, eps, {S('avg(score)')} AS score, count(*) AS n_trajectories FROM pt GROUP BY ALL")
def q_w26(spark, d):
    return sigs(W.window_means(_roll(spark, d, [0.0, 1e-9, EPS, EPS_FIX]), W.windows(spark)), "score")


@query("q_w27", "rows", f"WITH {_RS}, m AS (SELECT model, file, trajectory, eps, max(score) AS m FROM rs GROUP BY ALL) SELECT model, eps, {S('max(m)')} AS most, count(*) FILTER (WHERE m > 10) AS n_above FROM m GROUP BY ALL")
def q_w27(spark, d):
    m = _roll(spark, d).groupBy("model", "file", "trajectory", "eps").agg(F.max("score").alias("m"))
    return sigs(m.groupBy("model", "eps").agg(F.max("m").alias("most"), F.count_if(F.col("m") > 10).alias("n_above")), "most")


_TWO = "two AS (SELECT model, eps, file, trajectory, max(CASE WHEN r = 2 THEN x END) AS x_before, max(CASE WHEN r = 1 THEN x END) AS x_last, max(CASE WHEN r = 2 THEN y END) AS y_before, max(CASE WHEN r = 1 THEN y END) AS y_last FROM (SELECT *, row_number() OVER (PARTITION BY model, eps, file, trajectory ORDER BY x DESC) AS r FROM os) q WHERE r <= 2 GROUP BY ALL)"


@query("q_w28", "rows", f"WITH {_OS}, {_TWO} SELECT model, eps, file, trajectory, x_before, x_last, {S('y_before')} AS y_before, {S('y_last')} AS y_last, {S('100 * (y_before - y_last) / y_before', 4)} AS drop_percent FROM two")
def q_w28(spark, d):
    out = W.tail_slope(_starts(spark, d))
    return sigs(out.withColumn("drop_percent", sig(F.col("drop_percent"), 4)), "y_before", "y_last")


@query("q_w29", "rows", f"WITH {_PT}, l AS (SELECT *, (sum(score) OVER w - score) / (count(*) OVER w - 1) AS loo FROM pt WINDOW w AS (PARTITION BY model, label, eps)) SELECT model, label, eps, {S('min(score)')} AS least, {S('max(score)')} AS most, {S('median(score)')} AS median, {S('max(score) / min(score)')} AS ratio, {S('100 * stddev_samp(score) / avg(score)')} AS cv, {S('min(loo)')} AS loo_least, {S('max(loo)')} AS loo_most FROM l GROUP BY ALL")
def q_w29(spark, d):
    return sigs(W.dispersion(_per(spark, d), ["model", "label", "eps"]), "least", "most", "median", "ratio", "cv", "loo_least", "loo_most")


@query("q_w30", "rows", "SELECT model, file, trajectory, count(*) AS n, count(DISTINCT rollout_step) AS distinct_steps, count(*) FILTER (WHERE field_idx = 0) AS n_first, count(DISTINCT rollout_step) = 7 AND count(*) FILTER (WHERE field_idx = 0) = 7 AS exact FROM rows WHERE mode = 'rollout' AND rollout_step BETWEEN 6 AND 12 GROUP BY ALL")
def q_w30(spark, d):
    return W.exact_steps(V.rows(spark, d), 6, 12)


@query("q_w31", "rows", "SELECT model, mode, field, count(*) FILTER (WHERE sqrt(mse) > (sqrt(var) + sqrt(pvar)) * (1 + 1e-12)) AS n_far, count(*) AS n FROM rows WHERE field_idx > 0 GROUP BY ALL")
def q_w31(spark, d):
    return W.displacements(V.rows(spark, d))


@query("q_w32", "rows", f"WITH {_OS}, {_RS}, u AS (SELECT 'start' AS kind, model, x AS at_, y, eps FROM os UNION ALL SELECT 'step', model, rollout_step, score, eps FROM rs) SELECT kind, model, at_, {S('avg(y) FILTER (WHERE eps = 1e-7)')} AS at_eps, {S('avg(y) FILTER (WHERE eps = 1e-5)')} AS at_fix, {S('avg(y) FILTER (WHERE eps = 1e-7) / avg(y) FILTER (WHERE eps = 1e-5)')} AS ratio FROM u GROUP BY ALL")
def q_w32(spark, d):
    """Tables by start and by rollout step at two floors."""
    start = W.two_floors(_starts(spark, d), "x").withColumnRenamed("x", "at_").withColumn("kind", F.lit("start"))
    step = W.two_floors(_roll(spark, d).withColumnRenamed("score", "y"), "rollout_step").withColumnRenamed("rollout_step", "at_").withColumn("kind", F.lit("step"))
    return sigs(start.unionByName(step), "at_eps", "at_fix", "ratio")


@query("q_w33", "rows", f"WITH m AS (SELECT model, field, avg(sqrt(mse / (var + 1e-7))) AS s FROM rows WHERE mode = 'onestep' GROUP BY ALL) SELECT a.model, z.model AS surface, a.field, {S('a.s')} AS score, round(a.s - z.s, 6) + 0.0 AS difference FROM m a JOIN m z ON z.field = a.field")
def q_w33(spark, d):
    """Each model's field means against those of every model as a published surface."""
    m = V.rows(spark, d).where("mode = 'onestep'").groupBy("model", "field").agg(F.avg(vrmse(F.col("mse"), F.col("var"), EPS)).alias("score"))
    out = W.surface_differences(m, m.select(F.col("model").alias("surface"), "field", F.col("score").alias("value")))
    return out.select("model", "surface", "field", sig(F.col("score")).alias("score"), (F.round("difference", 6) + 0.0).alias("difference"))


@query("q_w34", "rows", f"SELECT model, file, field, {S('max(sqrt(mse / (var + 1e-7)))')} AS requested, {S('max(sqrt(mse / (var + 1e-5)))')} AS fallback, {S('max(sqrt((var + 1e-5) / (var + 1e-7)))')} AS amplification FROM rows GROUP BY ALL")
def q_w34(spark, d):
    v = F.col("var")
    return sigs(V.rows(spark, d).groupBy("model", "file", "field").agg(F.max(vrmse(F.col("mse"), v, EPS)).alias("requested"), F.max(vrmse(F.col("mse"), v, EPS_FIX)).alias("fallback"), F.max(F.sqrt(safe_div(v + EPS_FIX, v + EPS))).alias("amplification")), "requested", "fallback", "amplification")


_FS = "fs AS (SELECT field, greatest(stddev_samp(x), 1e-4) AS sd FROM grid GROUP BY field)"


@query("q_w35", "grid", f"WITH {_PERS}, {_GVAR}, {_FS} SELECT file, trajectory, t, field, {S('sqrt(persistence_mse / (var + 1e-7))')} AS raw, {S('sqrt(persistence_mse / (sd * sd) / (var / (sd * sd) + 1e-7))')} AS normalised FROM pm JOIN gv USING (file, trajectory, t, field) JOIN fs USING (field) WHERE persistence_mse IS NOT NULL")
def q_w35(spark, d):
    g = V.grid(spark, d)
    sd = g.groupBy("field").agg(F.greatest(F.stddev_samp("x"), F.lit(1e-4)).alias("sd"))
    j = A.frame_stats(g).where("persistence_mse is not null").join(F.broadcast(sd), "field")
    s2 = F.col("sd") * F.col("sd")
    return j.select(*FRAME, "field", sig(vrmse(F.col("persistence_mse"), F.col("var"), EPS)).alias("raw"), sig(vrmse(F.col("persistence_mse") / s2, F.col("var") / s2, EPS)).alias("normalised"))


@query("q_w36", "rows", f"WITH a AS (SELECT file, trajectory, t, field, mse FROM rows WHERE model = 'persistence' AND mode = 'onestep'), b AS (SELECT file, trajectory, t, field, mse FROM rows WHERE model = 'persistence' AND mode = 'rollout'), j AS (SELECT coalesce(a.field, b.field) AS field, coalesce(a.file, b.file) AS file, a.mse AS x, b.mse AS y, a.file IS NOT NULL AND b.file IS NOT NULL AS met FROM a FULL JOIN b USING (file, trajectory, t, field)) SELECT field, file, count(*) AS n_windows, count(*) FILTER (WHERE met) AS n_compared, bool_and(met) AS complete, {S('max(CASE WHEN met THEN abs(x - y) END)')} AS worst, bool_and(met AND x = y) AS identical FROM j GROUP BY ALL")
def q_w36(spark, d):
    """Persistence in one step and in a rollout as two legs: the same at the first step, else not; only early frames have both."""
    r = V.rows(spark, d).where("model = 'persistence'")
    leg = lambda mode: r.where(F.col("mode") == mode)
    return sigs(Q.equivalence(leg("onestep"), leg("rollout"), ["file", "trajectory", "t", "field"], ["field", "file"]).drop("worst_relative"), "worst")


@query("q_j1", "documents", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '?') AS status FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def q_j1(spark, d):
    lab = V.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").cast("string").alias("quality"))
    return V.table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit("?")).alias("status"))


@query("q_j2", "rows", f"WITH {_WIN} SELECT label, model, file, trajectory, rollout_step, field FROM rows JOIN win ON rollout_step BETWEEN lo AND hi WHERE mode = 'rollout'")
def q_j2(spark, d):
    return V.rows(spark, d).where("mode = 'rollout'").join(F.broadcast(W.windows(spark)), F.col("rollout_step").between(F.col("lo"), F.col("hi"))).select("label", "model", "file", "trajectory", "rollout_step", "field")


@query("q_j3", "rows", f"SELECT model, mode, file, trajectory, t, field, eps, {S('eps / (var + eps)')} AS share FROM rows CROSS JOIN {_EPS}")
def q_j3(spark, d):
    floors = spark.createDataFrame([(EPS,), (EPS_FIX,)], "eps double")
    return V.rows(spark, d).crossJoin(F.broadcast(floors)).select("model", "mode", *FRAME, "field", "eps", sig(F.col("eps") / (F.col("var") + F.col("eps"))).alias("share"))


@query("q_j4", "documents", "SELECT 'unlabelled' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) a UNION ALL SELECT 'unknown', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents) b")
def q_j4(spark, d):
    a, b = V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels").select("doc_id")
    side = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(a, b, "unlabelled").union(side(b, a, "unknown"))


@query("q_j5", "rows", "SELECT file, trajectory, t, 'union' AS op FROM (SELECT file, trajectory, t FROM rows WHERE mode = 'rollout' UNION SELECT file, trajectory, t FROM rows WHERE mode = 'onestep') a UNION ALL SELECT file, trajectory, t, 'intersect' FROM (SELECT file, trajectory, t FROM rows WHERE mode = 'rollout' INTERSECT SELECT file, trajectory, t FROM rows WHERE mode = 'onestep') b")
def q_j5(spark, d):
    rows = V.rows(spark, d)
    a, b = (rows.where(F.col("mode") == m).select(*FRAME) for m in ("rollout", "onestep"))
    return a.union(b).distinct().withColumn("op", F.lit("union")).union(a.intersect(b).withColumn("op", F.lit("intersect")))


@query("q_j6", "documents", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_j6(spark, d):
    return V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("q_j7", "cells", "SELECT file, trajectory, arg_min(cell, (density, cell)) AS at_least, arg_max(cell, (density, cell)) AS at_most FROM cells GROUP BY ALL")
def q_j7(spark, d):
    key = F.struct("density", "cell")
    return V.cells(spark, d).groupBy("file", "trajectory").agg(F.min_by("cell", key).alias("at_least"), F.max_by("cell", key).alias("at_most"))


@query("q_j8", "rows", "SELECT model, file, trajectory, input_start FROM (SELECT DISTINCT model, file, trajectory, input_start, dense_rank() OVER (PARTITION BY model, file, trajectory ORDER BY input_start DESC) AS r FROM rows WHERE mode = 'onestep') q WHERE r <= 2")
def q_j8(spark, d):
    w = Window.partitionBy("model", "file", "trajectory").orderBy(F.col("input_start").desc())
    s = V.rows(spark, d).where("mode = 'onestep'").select("model", "file", "trajectory", "input_start").distinct()
    return s.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@query("q_j9", "rows", "SELECT model, mode, field, CAST(row_number() OVER (ORDER BY list_position(['zero', 'persistence', 'bias'], model), n DESC, mode, field) AS INT) AS place FROM (SELECT model, mode, field, count(*) AS n FROM rows GROUP BY ALL) q")
def q_j9(spark, d):
    n = V.rows(spark, d).groupBy("model", "mode", "field").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, ("zero", "persistence", "bias"))), F.col("model"))
    return n.select("model", "mode", "field", F.row_number().over(Window.orderBy(rank, F.col("n").desc(), "mode", "field")).alias("place"))


@query("q_j10", "rows", "SELECT DISTINCT file, trajectory FROM rows ORDER BY 1, 2")
def q_j10(spark, d):
    return V.rows(spark, d).select("file", "trajectory").distinct().orderBy("file", "trajectory")


@query("q_j11", "curve", f"WITH p AS (SELECT trajectory, x, avg(y) AS y FROM curve GROUP BY ALL), q AS (SELECT DISTINCT trajectory, g FROM p, (VALUES (5), (15), (40)) g(g)) SELECT q.trajectory, q.g, p.x, {S('p.y', 4)} AS y FROM q ASOF LEFT JOIN p ON p.trajectory = q.trajectory AND q.g >= p.x")
def q_j11(spark, d):
    """As-of: queries and samples in one ordered table, the last sample carried on."""
    p = V.curve(spark, d).groupBy("trajectory", "x").agg(F.avg("y").alias("y"))
    ask = p.select("trajectory").distinct().withColumn("g", F.explode(F.array(F.lit(5), F.lit(15), F.lit(40))))
    both = p.select("trajectory", F.col("x").alias("at"), F.lit(0).alias("asks"), F.struct("x", "y").alias("s")).unionByName(ask.select("trajectory", F.col("g").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<x:int,y:double>").alias("s")))
    w = Window.partitionBy("trajectory").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("asks = 1").select("trajectory", F.col("at").alias("g"), "s.x", sig(F.col("s.y"), 4).alias("y"))
