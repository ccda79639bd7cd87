"""The working tables derived from the driver's tables: cells, grid, preds, score rows, vectors, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldgauge.functions import variance

FIELDS = ["density", "vx", "vy", "vz"]
FRAME = ["file", "trajectory", "t"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a cell of a frame with four fields; three of them grow with time."""
    li = table(spark, sf_dir, "lineitem")
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    a = (m - 23940).cast("double") / 84.0
    d, x = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04
    return li.select(
        F.col("l_returnflag").alias("file"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("trajectory"),
        (m - 23941).cast("int").alias("t"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"),
        (F.col("l_suppkey") % 10).alias("site"),
        (F.col("l_extendedprice") / 100000.0).alias("density"),
        (d * a * a * a * a).alias("vx"),
        (x * a * a * a * a).alias("vy"),
        (d * x * 100 * a * a).alias("vz"),
    )


def long_fields(df: DataFrame, keys: list[str], name: str = "x") -> DataFrame:
    """One row for each field: field, field_idx, value."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_idx"), F.col(f).alias(name)) for i, f in enumerate(FIELDS)))
    return df.select(*keys, F.inline(each))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned sites: the mean of each field per site and frame, long over fields; one aggregation."""
    keys = [*FRAME, "site"]
    return long_fields(cells(spark, sf_dir).groupBy(*keys).agg(*(F.avg(f).alias(f) for f in FIELDS)), keys)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and prediction per site: persistence, zero and a shifted target, one-step and rollout.

    One pass over the grid: a site's frames are sorted once, which gives the frame before and that of t = 3.
    """
    site = Window.partitionBy("file", "trajectory", "field_idx", "site").orderBy("t")
    whole = site.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.max(F.when(F.col("t") == 3, F.struct("x"))).over(whole)
    before = F.when(F.lag("t").over(site) == F.col("t") - 1, F.struct(F.lag("x").over(site).alias("x")))
    g = grid(spark, sf_dir).withColumns({"_before": before, "_start": start}).where("t >= 4").withColumnRenamed("x", "target")
    early, none = F.col("t") <= 33, F.lit(None).cast("int")

    def kind(model: str, mode: str, there: Column, pred: Column) -> Column:
        step, start_ = (F.col("t") - 3, none) if mode == "rollout" else (none, F.col("t") - 4)
        return F.when(there, F.struct(F.lit(model).alias("model"), F.lit(mode).alias("mode"), step.alias("rollout_step"), start_.alias("input_start"), pred.alias("pred")))

    made = [kind("persistence", "onestep", F.col("_before").isNotNull(), F.col("_before.x")), kind("persistence", "rollout", early & F.col("_start").isNotNull(), F.col("_start.x"))]
    for model, gain, shift in (("zero", 0.0, 0.0), ("bias", 1.0, 0.01)):
        made += [kind(model, mode, early if mode == "rollout" else F.lit(True), F.col("target") * gain + shift) for mode in ("onestep", "rollout")]
    each = g.select(*FRAME, "field", "field_idx", "site", "target", F.inline(F.array_compact(F.array(*made))))
    return each.select("model", "mode", *FRAME, "rollout_step", "input_start", "field", "field_idx", "site", "target", "pred")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows, long over fields: mse, target variance and prediction variance of each window."""
    keys = ["model", "mode", *FRAME, "rollout_step", "input_start", "field", "field_idx"]
    d = F.col("pred") - F.col("target")
    return preds(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n_cells"), F.avg(d * d).alias("mse"), variance(F.col("target")).alias("var"), variance(F.col("pred")).alias("pvar"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("trajectory"), F.col("vec_id").alias("t"), "embedding")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples per trajectory and model."""
    x = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trajectory"), F.col("event_type").alias("model"), "ts", x.alias("x"), F.col("value").alias("y"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


#: The same tables for DuckDB.
SQL = {
    "cells": """SELECT l_returnflag AS file, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS trajectory, CAST(m - 23941 AS INT) AS t,
  l_orderkey * 10 + l_linenumber AS cell, l_suppkey % 10 AS site, l_extendedprice / CAST(100000 AS DOUBLE) AS density,
  (l_discount - CAST(0.05 AS DOUBLE)) * a * a * a * a AS vx, (l_tax - CAST(0.04 AS DOUBLE)) * a * a * a * a AS vy,
  (l_discount - CAST(0.05 AS DOUBLE)) * (l_tax - CAST(0.04 AS DOUBLE)) * 100 * a * a AS vz
FROM (SELECT *, CAST(m - 23940 AS DOUBLE) / CAST(84 AS DOUBLE) AS a FROM (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem) q1) q2""",
    "grid": " UNION ALL ".join(f"SELECT file, trajectory, t, site, '{f}' AS field, {i} AS field_idx, avg({f}) AS x FROM cells GROUP BY file, trajectory, t, site" for i, f in enumerate(FIELDS)),
    "preds": """SELECT 'persistence' AS model, 'onestep' AS mode, g.file, g.trajectory, g.t, CAST(NULL AS INT) AS rollout_step, g.t - 4 AS input_start, g.field, g.field_idx, g.site, g.x AS target, p.x AS pred
FROM grid g JOIN grid p ON p.file = g.file AND p.trajectory = g.trajectory AND p.field_idx = g.field_idx AND p.site = g.site AND p.t = g.t - 1 WHERE g.t >= 4
UNION ALL SELECT 'persistence', 'rollout', g.file, g.trajectory, g.t, g.t - 3, CAST(NULL AS INT), g.field, g.field_idx, g.site, g.x, p.x
FROM grid g JOIN grid p ON p.file = g.file AND p.trajectory = g.trajectory AND p.field_idx = g.field_idx AND p.site = g.site AND p.t = 3 WHERE g.t BETWEEN 4 AND 33
UNION ALL SELECT s.model, CASE WHEN s.k = 0 THEN 'onestep' ELSE 'rollout' END, g.file, g.trajectory, g.t, CASE WHEN s.k = 1 THEN g.t - 3 END, CASE WHEN s.k = 0 THEN g.t - 4 END, g.field, g.field_idx, g.site, g.x, g.x * s.gain + s.shift
FROM grid g CROSS JOIN (VALUES ('zero', 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)), ('zero', 1, 0, 0), ('bias', 0, 1, 0.01), ('bias', 1, 1, 0.01)) s(model, k, gain, shift) WHERE g.t >= 4 AND (s.k = 0 OR g.t <= 33)""",
    "rows": """SELECT model, mode, file, trajectory, t, rollout_step, input_start, field, field_idx, count(*) AS n_cells,
  avg((pred - target) * (pred - target)) AS mse, """ + ", ".join(f"CASE WHEN var_samp({x}) <= 1e-15 * avg({x} * {x}) THEN CAST(0 AS DOUBLE) ELSE var_samp({x}) END AS {n}" for x, n in (("target", "var"), ("pred", "pvar"))) + " FROM preds GROUP BY ALL",
    "vec": "SELECT CAST(label AS INT) AS trajectory, vec_id AS t, embedding FROM embeddings",
    "curve": "SELECT user_id AS trajectory, event_type AS model, ts, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS x, value AS y FROM events",
    "docs": "SELECT doc_id, text FROM documents",
}
_NEEDS = {"grid": ["cells"], "preds": ["cells", "grid"], "rows": ["cells", "grid", "preds"]}


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query with the named views, and those that they need, in front of it."""
    wanted = list(dict.fromkeys(v for n in names for v in [*_NEEDS.get(n, []), n]))
    # the list before the query's own, if it has one
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    sql = sql.strip()
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
