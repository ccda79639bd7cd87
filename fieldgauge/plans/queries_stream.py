"""Registered queries with user functions and streams (F5, F6, T2), and the event-time monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge.functions import EPS, sig
from fieldgauge.operators import layout as L
from fieldgauge.plans.queries_frames import _PERS
from fieldgauge.plans.queries_tables import _FRAMES, _frames
from fieldgauge.plans.registry import S, query
from fieldgauge.sources import views as V
from fieldgauge.sources.files import shared
from fieldgauge.streaming import jobs


def _last(inputs):
    """Persistence, as a user's model would be given."""
    return [x[-1] for x in inputs]


@query("q_f5", "grid", f"WITH {_FRAMES} SELECT file, trajectory, field, t - 4 AS start, round(p, 9) + 0.0 AS pred FROM (SELECT *, lag(x) OVER w AS p, count(*) OVER h AS n FROM fr WINDOW w AS (PARTITION BY file, trajectory, field ORDER BY t), h AS (PARTITION BY file, trajectory, field ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) q WHERE n = 4")
def q_f5(spark, d):
    w = L.history_windows(_frames(spark, d), ["file", "trajectory", "field"]).select("file", "trajectory", "field", "start", "inputs")
    return jobs.one_step_forecasts(w, _last).select("file", "trajectory", "field", "start", (F.round("pred", 9) + 0.0).alias("pred"))


@query("q_f6", "grid", f"WITH s AS (SELECT file, trajectory, site, field_idx, arg_max(x, t) AS x FROM grid WHERE t < 4 GROUP BY ALL HAVING count(*) = 4) SELECT file, trajectory, site, CAST(field_idx AS INT) AS field_idx, CAST(k AS INT) AS rollout_step, round(x, 9) + 0.0 AS pred FROM s, range(1, 31) r(k)")
def q_f6(spark, d):
    """The model is given each field of each site as a channel."""
    n = len(V.FIELDS)
    g = V.grid(spark, d).select("file", "trajectory", (F.col("site") * n + F.col("field_idx")).alias("site"), "t", "x")
    made = jobs.rollout_forecasts(g, _last, 30)
    return made.select("file", "trajectory", F.expr(f"site div {n}").alias("site"), (F.col("site") % n).cast("int").alias("field_idx"), "rollout_step", (F.round("pred", 9) + 0.0).alias("pred"))


@query("q_t2", "grid", f"WITH {_PERS} SELECT file, trajectory, field, t, {S('persistence_mse', 5)} AS persistence_mse FROM pm WHERE persistence_mse IS NOT NULL")
def q_t2(spark, d):
    """Frames dealt over batches out of order, paired by state; compared with the batch operator."""
    base = shared(spark)
    frames = V.grid(spark, d).groupBy("file", "trajectory", "field", "t").agg(F.array_sort(F.collect_list(F.struct("site", "x"))).alias("cells"))
    # three files, so three batches, none of which has the frames of a trajectory in order or without gaps
    frames.repartition(3, F.col("t") * 7 % 11).write.parquet(f"{base}/frames")
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/frames")
    jobs.persistence_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file", "trajectory", "field", "t", sig(F.col("persistence_mse"), 5).alias("persistence_mse"))


@query("q_x1", "events", f"WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, var_samp(value) AS v, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, event_type, n, {S('v', 4)} AS var FROM e")
def q_x1(spark, d):
    m = jobs.conditioning_monitor(V.table(spark, d, "events"), EPS)
    return m.select(F.to_date("start").cast("string").alias("day"), "event_type", "n", sig(F.col("var"), 4).alias("var"))
