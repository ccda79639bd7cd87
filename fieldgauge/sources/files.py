"""Readers and writers of score rows, audits, censuses, window tables and logs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "file string, trajectory int, mode string, model string, t int, rollout_step int, input_start int, mse array<double>, target_variance_ddof1 array<double>, pred_variance_ddof1 array<double>"
PAYLOAD = f"fields array<string>, provenance struct<repo:string,revision:string,device:string,dataset_url:string,history:int,captured_utc:string>, rows array<struct<{', '.join(c.replace(' ', ':', 1) for c in ROW.split(', '))}>>"
AUDIT = "file string, trajectory int, fields array<string>, rows array<struct<t:int,variance_ddof1:array<double>,spatial_mean:array<double>,persistence_mse:array<double>>>"
CENSUS = "dataset string, n_test_files_total int, window_frames array<int>, frame_stride int, eps_lib double, eps_fix double, files_censused array<string>, files map<string, struct<fields:map<string, struct<var_min:double,var_max:double,var_mean:double,frac_below_epslib:double,frac_below_epsfix:double,n_frames:int,window:array<int>>>, sec:double, static_fields_excluded:array<string>, error:string>>"


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see; only a local session may do without a named one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder}/{uuid.uuid4().hex}" if folder else tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame) -> DataFrame:
    """The rows, written to a new shared folder and read again: lost executors cost no more than their tasks."""
    at = shared(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_score_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each window and field of gz JSON payloads."""
    each = spark.read.schema(PAYLOAD).json(path, multiLine=True).select("fields", F.explode("rows").alias("r"))
    zipped = F.arrays_zip("fields", "r.mse", "r.target_variance_ddof1", "r.pred_variance_ddof1")
    long = each.select("r.file", "r.trajectory", "r.mode", "r.model", "r.t", "r.rollout_step", "r.input_start", F.posexplode(zipped).alias("field_idx", "z"))
    return long.select("file", "trajectory", "mode", "model", "t", "rollout_step", "input_start", F.col("z.fields").alias("field"), "field_idx", F.col("z.mse").alias("mse"), F.col("z.target_variance_ddof1").alias("var"), F.col("z.pred_variance_ddof1").alias("pvar"))


def write_score_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by model and mode, or gz JSON for exchange, a payload a file (S3)."""
    if fmt == "parquet":
        rows.write.partitionBy("model", "mode").parquet(path)
    elif fmt == "json":
        rows.write.option("maxRecordsPerFile", 1).json(path, compression="gzip")
    else:
        raise ValueError(f"no such format: {fmt}")


def as_payloads(rows: DataFrame) -> DataFrame:
    """Long score rows folded into payloads, one for each model and trajectory; a trajectory has few windows."""
    f = F.array_sort(F.collect_list(F.struct("field_idx", "field", "mse", "var", "pvar")))
    row = rows.groupBy("model", "mode", "file", "trajectory", "t", "rollout_step", "input_start").agg(f.alias("f"))
    struct = F.struct("file", "trajectory", "mode", "model", "t", "rollout_step", "input_start", F.col("f.mse").alias("mse"), F.col("f.var").alias("target_variance_ddof1"), F.col("f.pvar").alias("pred_variance_ddof1"))
    return row.groupBy("model", "file", "trajectory").agg(F.first("f.field").alias("fields"), F.collect_list(struct).alias("rows")).select("fields", "rows")


def read_audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows with the file and trajectory of their payload (S2); persistence is null on a first frame."""
    each = spark.read.schema(AUDIT).json(path, multiLine=True).select("file", "trajectory", "fields", F.explode("rows").alias("r"))
    z = each.select("file", "trajectory", "r.t", F.posexplode(F.arrays_zip("fields", "r.variance_ddof1", "r.spatial_mean", "r.persistence_mse")).alias("field_idx", "z"))
    return z.select("file", "trajectory", "t", F.col("z.fields").alias("field"), "field_idx", F.col("z.variance_ddof1").alias("var"), F.col("z.spatial_mean").alias("mean"), F.col("z.persistence_mse").alias("persistence_mse"))


def write_audits(frames: DataFrame, path: str) -> None:
    """Long audit rows (`field`, `field_idx`, var, mean, persistence_mse) as documents, one for each trajectory."""
    f = F.array_sort(F.collect_list(F.struct("field_idx", "field", "var", "mean", "persistence_mse")))
    row = frames.groupBy("file", "trajectory", "t").agg(f.alias("f"))
    entry = F.struct("t", F.col("f.var").alias("variance_ddof1"), F.col("f.mean").alias("spatial_mean"), F.col("f.persistence_mse").alias("persistence_mse"))
    docs = row.groupBy("file", "trajectory").agg(F.first("f.field").alias("fields"), F.array_sort(F.collect_list(entry), lambda a, b: a["t"] - b["t"]).alias("rows"))
    docs.write.option("maxRecordsPerFile", 1).json(path, compression="gzip")


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """dataset, file, field and statistics of census documents (S4); the maps are never inferred."""
    files = spark.read.schema(CENSUS).json(path, multiLine=True).select("dataset", "n_test_files_total", "frame_stride", F.explode("files").alias("file", "v"))
    return files.select("dataset", "n_test_files_total", "frame_stride", "file", F.explode("v.fields").alias("field", "s")).select("dataset", "n_test_files_total", "frame_stride", "file", "field", "s.*")


def write_census(census: DataFrame, path: str, run: dict | None = None) -> None:
    """One document for each dataset, with its files and fields as maps and what the run was.

    ``run`` may give ``window`` (first and last frame), ``stride``, ``eps_lib`` and ``eps_fix``; how many files a dataset has and which were
    taken follows from the census. A dataset has few files and fields, so a document is one row.
    """
    stats = F.struct(F.col("var_min"), F.col("var_max"), F.col("var_mean"), F.col("frac_below_epslib"), F.col("frac_below_epsfix"), F.col("n_frames"))
    per = census.groupBy("dataset", "file").agg(F.map_from_entries(F.collect_list(F.struct("field", stats))).alias("fields"))
    docs = per.groupBy("dataset").agg(F.count("*").cast("int").alias("n_test_files_total"), F.array_sort(F.collect_list("file")).alias("files_censused"), F.map_from_entries(F.collect_list(F.struct("file", F.struct("fields")))).alias("files"))
    told = {"window_frames": F.array(*(F.lit(x).cast("int") for x in run["window"])), "frame_stride": F.lit(run["stride"]).cast("int"), "eps_lib": F.lit(run["eps_lib"]), "eps_fix": F.lit(run["eps_fix"])} if run else {}
    docs.withColumns(told).write.option("maxRecordsPerFile", 1).json(path)


def write_windows_csv(rows: DataFrame, path: str) -> None:
    """Score rows as CSV with a header (S6); nulls are empty."""
    rows.write.option("header", True).csv(path)


def melt_published(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """Nested maps of cells as rows (S12): a column for each level, the cell, its value and whether it is ``censored``.

    A cell such as ">10" is censored and has no value; a null map or cell has no row.
    """
    keep = [c for c in df.columns if c != col]
    for level in levels:
        df = df.select(*keep, F.explode(col).alias(level, "_inner")).withColumnRenamed("_inner", col)
        keep.append(level)
    cell = F.col(col).cast("string")
    return df.where(F.col(col).isNotNull()).select(*keep, cell.alias("cell"), cell.try_cast("double").alias("value"), cell.startswith(">").alias("censored"))


def read_log_verdict(spark: SparkSession, path: str) -> DataFrame:
    """Largest relative difference and verdict of each text log."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_extract("value", r"(?i)max(?:imum)?[^\n:=]*[:=]\s*([-+0-9.eE]+)", 1).try_cast("double").alias("worst"), F.regexp_extract("value", r"(?i)\b(PASS|FAIL)\b", 1).alias("verdict"))
