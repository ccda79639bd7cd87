"""Registered queries of sources and sinks: what is derived from the tables is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge.functions import EPS, EPS_FIX, sig
from fieldgauge.operators import census as M
from fieldgauge.operators import frames as A
from fieldgauge.plans.queries_frames import _GVAR, _PERS, _VAR
from fieldgauge.plans.registry import VAR, S, query
from fieldgauge.sources import files
from fieldgauge.sources import views as V
from fieldgauge.sources.files import shared
from fieldgauge.sources.views import FRAME
from fieldgauge.streaming import jobs

_WINDOW = "model, mode, file, trajectory, t, rollout_step, input_start, field, field_idx"


def _windows(rows):
    return rows.select(*_WINDOW.split(", "), sig(F.col("mse")).alias("mse"), sig(F.col("var")).alias("var"))


@query("q_s1", "rows", f"SELECT {_WINDOW}, {S('mse')} AS mse, {S('var')} AS var FROM rows")
def q_s1(spark, d):
    """Score rows as payload documents, one for each model and trajectory."""
    at = f"{shared(spark)}/payloads"
    files.write_score_rows(files.as_payloads(V.rows(spark, d)), at, "json")
    return _windows(files.read_score_rows(spark, at))


_MEAN = "gm AS (SELECT file, trajectory, t, field, avg(x) AS mean FROM grid GROUP BY ALL)"


@query("q_s2", "grid", f"WITH {_PERS}, {_GVAR}, {_MEAN} SELECT file, trajectory, t, field, field_idx, {S('var')} AS var, round(mean, 9) + 0.0 AS mean, {S('persistence_mse')} AS persistence_mse FROM pm JOIN gv USING (file, trajectory, t, field) JOIN gm USING (file, trajectory, t, field)")
def q_s2(spark, d):
    """Audits of trajectories as documents with one entry for each frame."""
    at = f"{shared(spark)}/audits"
    files.write_audits(A.frame_stats(V.grid(spark, d)), at)
    back = files.read_audit_rows(spark, at)
    return back.select(*FRAME, "field", "field_idx", sig(F.col("var")).alias("var"), (F.round("mean", 9) + 0.0).alias("mean"), sig(F.col("persistence_mse")).alias("persistence_mse"))


@query("q_s3", "rows", f"SELECT {_WINDOW}, {S('mse')} AS mse, {S('var')} AS var FROM rows")
def q_s3(spark, d):
    """Score rows as a table partitioned by model and mode."""
    at = f"{shared(spark)}/rows"
    files.write_score_rows(V.rows(spark, d), at)
    return _windows(spark.read.schema("file string, trajectory int, t int, rollout_step int, input_start int, field string, field_idx int, n_cells bigint, mse double, var double, pvar double, model string, mode string").parquet(at))


_STATS = ("var_min", "var_max", "var_mean", "frac_below_epslib", "frac_below_epsfix")
_CENSUS = f"WITH {_VAR} SELECT file AS dataset, CAST(trajectory AS VARCHAR) AS file, field, {S('min(var)')} AS var_min, {S('max(var)')} AS var_max, {S('avg(var)')} AS var_mean, {S('avg(CAST(var <= 1e-7 AS INT))')} AS frac_below_epslib, {S('avg(CAST(var <= 1e-5 AS INT))')} AS frac_below_epsfix, count(*) AS n_frames FROM fv GROUP BY ALL"


def _written_census(spark, d):
    at = f"{shared(spark)}/census"
    c = M.component_census(A.long_variance(V.cells(spark, d)), ["file", "trajectory", "field"]).withColumnsRenamed({"file": "dataset", "frac_le_eps": "frac_below_epslib", "frac_le_fix": "frac_below_epsfix"})
    files.write_census(c.withColumn("file", F.col("trajectory").cast("string")), at, {"window": (0, 83), "stride": 1, "eps_lib": EPS, "eps_fix": EPS_FIX})
    return at


@query("q_s4", "cells", _CENSUS)
def q_s4(spark, d):
    """Census documents with maps of files and fields, read as rows."""
    return files.read_census(spark, _written_census(spark, d)).select("dataset", "file", "field", *(sig(F.col(c)).alias(c) for c in _STATS), F.col("n_frames").cast("long").alias("n_frames"))


@query("q_s5", "cells", f"WITH c AS ({_CENSUS}) SELECT dataset, count(DISTINCT file) AS n_files, count(*) AS n_entries, string_agg(DISTINCT file, ',' ORDER BY file) AS taken, CAST(count(DISTINCT file) AS INT) AS n_test_files_total, 0 AS first, 83 AS last, 1 AS frame_stride, CAST(1e-7 AS DOUBLE) AS eps_lib, CAST(1e-5 AS DOUBLE) AS eps_fix FROM c GROUP BY dataset")
def q_s5(spark, d):
    """What is in each census document, and what it says of its run."""
    docs = spark.read.schema(files.CENSUS).json(_written_census(spark, d))
    entries = F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda a, v: a + F.size(F.map_keys(v["fields"])))
    return docs.select("dataset", F.size(F.map_keys("files")).cast("long").alias("n_files"), entries.alias("n_entries"), F.array_join("files_censused", ",").alias("taken"), "n_test_files_total", F.get("window_frames", F.lit(0)).alias("first"), F.get("window_frames", F.lit(1)).alias("last"), "frame_stride", "eps_lib", "eps_fix")


@query("q_s6", "rows", f"SELECT model, file, trajectory, t, field, {S('mse')} AS mse FROM rows WHERE mode = 'rollout'")
def q_s6(spark, d):
    """Rollout windows as CSV with a header."""
    at = f"{shared(spark)}/windows"
    files.write_windows_csv(V.rows(spark, d).where("mode = 'rollout'").select("model", *FRAME, "field", "mse"), at)
    back = spark.read.option("header", True).schema("model string, file string, trajectory int, t int, field string, mse double").csv(at)
    return back.withColumn("mse", sig(F.col("mse")))


@query("q_t1", "grid", f"SELECT file, field, trajectory, count(*) AS n, {S(VAR('x'))} AS var FROM grid GROUP BY file, field, trajectory")
def q_t1(spark, d):
    """A census of each trajectory as it arrives; what a former run has taken is not read again."""
    base, g = shared(spark), V.grid(spark, d).select("file", "trajectory", "field", "x")
    each = lambda b: b.groupBy("file", "field", "trajectory").agg(F.count("*").alias("n"), F.var_samp("x").alias("var"))
    for k in (0, 1):
        g.where(F.col("trajectory") == k).write.mode("append").parquet(f"{base}/in")
        jobs.incremental_census(spark, g.schema, f"{base}/in", f"{base}/out", f"{base}/state", each)
    return jobs.read_batches(spark, f"{base}/out").withColumn("var", sig(F.col("var")))
