"""Registered queries: layout (P), sources and sinks (S), verification (V) and scalar functions (F)."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldgauge.functions import EPS, band, floor_share, nan_to_num, safe_div, sig, variance, vrmse
from fieldgauge.operators import census as M
from fieldgauge.operators import checks as K
from fieldgauge.operators import frames as A
from fieldgauge.operators import layout as L
from fieldgauge.operators import ranks as R
from fieldgauge.operators import records as Q
from fieldgauge.operators import screen as C
from fieldgauge.plans.queries_frames import sigs
from fieldgauge.plans.registry import S, query
from fieldgauge.sources import arrays, files
from fieldgauge.sources import views as V
from fieldgauge.sources.files import shared
from fieldgauge.sources.views import FIELDS, FRAME


@query("q_screen", "cells", f"WITH s AS (SELECT file, trajectory, t, var_samp(vx) AS v FROM cells GROUP BY ALL) SELECT file, trajectory, t, {S('v')} AS var_vx, {S('1e-7 / (v + 1e-7)')} AS share, CASE WHEN v IS NULL THEN 'undefined' WHEN 1e-7 / (v + 1e-7) < 0.01 THEN 'well-conditioned' WHEN 1e-7 / (v + 1e-7) < 0.5 THEN 'floor-sensitive' WHEN 1e-7 / (v + 1e-7) < 0.9 THEN 'floor-dominated' ELSE 'floor-determined' END AS band FROM s")
def q_screen(spark, d):
    v = A.frame_variance(V.cells(spark, d), fields=["vx"])
    share = floor_share(F.col("var_vx"), EPS)
    return v.select(*FRAME, sig(F.col("var_vx")).alias("var_vx"), sig(share).alias("share"), band(share).alias("band"))


@query("q_p1", "cells", "SELECT file, trajectory, t, count(*) AS n FROM cells WHERE t BETWEEN 4 AND 33 AND (t - 4) % 3 = 0 GROUP BY ALL")
def q_p1(spark, d):
    return L.frame_window(V.cells(spark, d).groupBy(*FRAME).agg(F.count("*").alias("n")), 4, 33, 3)


@query("q_p2", "grid", "WITH s AS (SELECT field, max(x) - min(x) > 1 AS moving FROM grid GROUP BY field) SELECT string_agg(field, ',' ORDER BY field) FILTER (WHERE NOT moving) AS excluded, count(*) FILTER (WHERE moving) AS n_kept FROM s")
def q_p2(spark, d):
    s = V.grid(spark, d).groupBy("field").agg((F.max("x") - F.min("x") > 1).alias("moving"))
    return s.agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("moving"), F.col("field")))), ",").alias("excluded"), F.count_if("moving").alias("n_kept"))


@query("q_p3", "orders", "WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM o), w AS (SELECT DISTINCT CAST(round_even(k * (SELECT max(i) FROM r) / 9e0, 0) AS BIGINT) AS i FROM range(0, 10) g(k)) SELECT CAST(day AS VARCHAR) AS day FROM r WHERE i IN (SELECT i FROM w)")
def q_p3(spark, d):
    return L.even_pick(V.table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day")), "day", 10)


_COMPONENT = "CASE vec_id % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'v.' || (i % 2) WHEN 2 THEN 'v.' || (i // 16) ELSE 'v.' || ((i // 2) % 4) || (i % 2) END"


@query("q_p4", "embeddings", f"WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT vec_id, i, x, {_COMPONENT} AS name FROM e) SELECT vec_id, name, count(*) AS n, CASE vec_id % 4 WHEN 0 THEN '64' WHEN 1 THEN '32' WHEN 2 THEN '16' ELSE '8' END AS shape, {S('avg(CAST(x AS DOUBLE))', 4)} AS mean, {S('var_pop(CAST(x AS DOUBLE))', 4)} AS var FROM c GROUP BY ALL")
def q_p4(spark, d):
    """Scalars, vectors with the last or the first axis for components, and tensors with the last two, by the number of the vector."""
    k, ints = F.col("vec_id") % 4, lambda *n: F.array(*map(F.lit, n))
    shape = F.when(k == 0, ints(64)).when(k == 1, ints(32, 2)).when(k == 2, ints(4, 16)).otherwise(ints(8, 4, 2))
    axes = F.when(k == 1, ints(-1)).when(k == 2, ints(0)).when(k == 3, ints(2, -2))
    fields = V.table(spark, d, "embeddings").select("vec_id", F.lit("v").alias("name"), shape.alias("shape"), F.transform("embedding", lambda x: x.cast("double")).alias("values"), axes.alias("axes"))
    parts = _array_stats(L.split_components(fields), "values")
    return parts.select("vec_id", "name", F.size("values").cast("long").alias("n"), F.concat_ws(",", F.transform("shape", lambda n: n.cast("string"))).alias("shape"), sig(F.col("mean"), 4).alias("mean"), sig(F.col("var"), 4).alias("var"))


def _array_stats(df, col):
    """Mean and population variance of an array, two passes over it, no explode."""
    n = F.size(col)
    mean = F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("mean", mean)
    return df.withColumn("var", F.aggregate(F.transform(col, lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x) / n)


def _catalogue(spark, d):
    """A field catalogue derived from the vectors: one field for each label, of rank 2 to 4."""
    n = V.vec(spark, d).groupBy("trajectory").agg(F.count("*").cast("int").alias("n"))
    shape = F.when(F.col("trajectory") % 3 == 0, F.array("n", F.lit(64))).when(F.col("trajectory") % 3 == 1, F.array("n", F.lit(32), F.lit(2))).otherwise(F.array("n", F.lit(8), F.lit(4), F.lit(2)))
    return n.select(F.concat(F.lit("f"), "trajectory").alias("name"), shape.alias("shape"))


_CAT = "cat AS (SELECT 'f' || label AS name, CASE label % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS r FROM (SELECT DISTINCT CAST(label AS INT) AS label FROM embeddings) q)"


@query("q_p5", "embeddings", f"WITH {_CAT} SELECT name, CASE WHEN r NOT IN (2, 3) THEN 'refused' WHEN r = 3 THEN 'split' ELSE 'whole' END AS decision, CASE WHEN r = 3 THEN -1 END AS axis, CASE WHEN r = 2 THEN 'assumed' END AS grade FROM cat")
def q_p5(spark, d):
    return L.resolve_layout(_catalogue(spark, d), 1, -1, n_leading=1).select("name", "decision", "axis", "grade")


@query("q_p6", "embeddings", "SELECT 'v.' || (vec_id % 100) AS name, count(*) AS n FROM embeddings GROUP BY ALL HAVING count(*) > 1")
def q_p6(spark, d):
    return L.collisions(V.table(spark, d, "embeddings").select(F.concat(F.lit("v."), F.col("vec_id") % 100).alias("name")))


@query("q_p7", "grid", "WITH s AS (SELECT field, avg(x) AS m, greatest(stddev_samp(x), 1e-4) AS sd FROM grid GROUP BY field) SELECT file, trajectory, t, site, g.field, round((x - m) / sd, 6) + 0.0 AS z, abs((x - m) / sd * sd + m - x) <= 1e-9 AS back FROM grid g JOIN s ON s.field = g.field")
def q_p7(spark, d):
    g = V.grid(spark, d)
    s = g.groupBy("field").agg(F.avg("x").alias("m"), F.greatest(F.stddev_samp("x"), F.lit(1e-4)).alias("sd"))
    z = (F.col("x") - F.col("m")) / F.col("sd")
    return g.join(F.broadcast(s), "field").select(*FRAME, "site", "field", (F.round(z, 6) + 0.0).alias("z"), (F.abs(z * F.col("sd") + F.col("m") - F.col("x")) <= 1e-9).alias("back"))


@query("q_p8", "grid", f"WITH s AS (SELECT field, greatest(stddev_samp(x), 1e-4) AS sd FROM grid GROUP BY field), v AS (SELECT field, file, trajectory, t, var_samp(x) AS v FROM grid GROUP BY ALL), m AS (SELECT field, min(v) AS v FROM v GROUP BY field) SELECT m.field, {S('1e-7 / (v + 1e-7)')} AS raw_share, {S('1e-7 / (v / (sd * sd) + 1e-7)')} AS z_share FROM m JOIN s ON s.field = m.field")
def q_p8(spark, d):
    g = V.grid(spark, d)
    s = g.groupBy("field").agg(F.greatest(F.stddev_samp("x"), F.lit(1e-4)).alias("sd"))
    m = g.groupBy(*FRAME, "field").agg(F.var_samp("x").alias("v")).groupBy("field").agg(F.min("v").alias("v"))
    return m.join(F.broadcast(s), "field").select("field", sig(floor_share(F.col("v"), EPS)).alias("raw_share"), sig(floor_share(F.col("v") / (F.col("sd") * F.col("sd")), EPS)).alias("z_share"))


_FRAMES = "fr AS (SELECT file, trajectory, field, t, avg(x) AS x FROM grid GROUP BY ALL)"


def _frames(spark, d):
    return V.grid(spark, d).groupBy(*FRAME, "field").agg(F.avg("x").alias("x"))


@query("q_p9", "grid", f"WITH {_FRAMES}, w AS (SELECT file, trajectory, field, t, x, count(*) OVER h AS n, sum(x) OVER h AS total FROM fr WINDOW h AS (PARTITION BY file, trajectory, field ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) SELECT file, trajectory, field, t - 4 AS start, round(total, 9) + 0.0 AS inputs_total, round(x, 9) + 0.0 AS target FROM w WHERE n = 4")
def q_p9(spark, d):
    w = L.history_windows(_frames(spark, d), ["file", "trajectory", "field"])
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    return w.select("file", "trajectory", "field", "start", (F.round(total, 9) + 0.0).alias("inputs_total"), (F.round("target", 9) + 0.0).alias("target"))


_WIDE = "fw AS (SELECT file, trajectory, t, avg(density) AS density, avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz FROM cells GROUP BY ALL), wd AS (SELECT file, trajectory, t - 4 AS start, list(density) OVER h AS d, list(vx) OVER h AS x, list(vy) OVER h AS y, list(vz) OVER h AS z FROM fw WINDOW h AS (PARTITION BY file, trajectory ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"


@query("q_p10", "cells", f"WITH {_WIDE}, c AS (SELECT file, trajectory, start, unnest(range(0, 16)) AS channel, d, x, y, z FROM wd WHERE len(d) = 4) SELECT file, trajectory, start, CAST(channel AS INT) AS channel, {S('CASE channel % 4 WHEN 0 THEN d[channel // 4 + 1] WHEN 1 THEN x[channel // 4 + 1] WHEN 2 THEN y[channel // 4 + 1] ELSE z[channel // 4 + 1] END', 5)} AS value FROM c")
def q_p10(spark, d):
    """Channels of each window of four frames, in their order."""
    frames = A.spatial_mean(V.cells(spark, d)).withColumn("x", F.struct(*(F.col(f"mean_{f}").alias(f) for f in FIELDS)))
    w = L.history_windows(frames.select(*FRAME, "x"), ["file", "trajectory"])
    return w.select("file", "trajectory", "start", F.posexplode(L.flatten_channels(F.col("inputs"), FIELDS)).alias("channel", "value")).withColumn("value", sig(F.col("value"), 5))


@query("q_p11", "events", f"WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN var_samp(value) IS NULL THEN 0 ELSE var_samp(value) END AS v FROM events GROUP BY ALL) SELECT user_id, CAST(day AS VARCHAR) AS day, {S('v * sqrt(2)', 5)} AS filled FROM v")
def q_p11(spark, d):
    v = V.table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.coalesce(F.var_samp("value"), F.lit(float("nan"))).alias("v"))
    return v.select("user_id", "day", sig(nan_to_num(F.col("v")) * F.sqrt(F.lit(2.0)), 5).alias("filled"))


@query("q_p12", "curve", "WITH x AS (SELECT DISTINCT trajectory, x AS t FROM curve), g AS (SELECT *, t - row_number() OVER (PARTITION BY trajectory ORDER BY t) AS g FROM x) SELECT trajectory, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY trajectory, g")
def q_p12(spark, d):
    return L.runs(V.curve(spark, d).withColumnRenamed("x", "t"), ["trajectory"])


@query("q_p13", "rows", "WITH s AS (SELECT DISTINCT file, trajectory, input_start AS s FROM rows WHERE mode = 'onestep' AND input_start % 10 = 0), a AS (SELECT file, trajectory, unnest(range(s, s + 5)) AS t FROM s UNION SELECT file, trajectory, unnest(range(0, 34)) FROM (SELECT DISTINCT file, trajectory FROM rows) q) SELECT file, trajectory, CAST(t AS INT) AS t FROM a")
def q_p13(spark, d):
    rows = V.rows(spark, d)
    s = rows.where("mode = 'onestep' and input_start % 10 = 0").select("file", "trajectory", F.explode(F.sequence("input_start", F.col("input_start") + 4)).alias("t"))
    r = rows.select("file", "trajectory").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(33))))
    return s.union(r).distinct()


@query("q_p14", "rows", "SELECT DISTINCT mode, t, rollout_step, input_start, CASE WHEN mode = 'rollout' THEN t = 4 + rollout_step - 1 ELSE t = input_start + 4 END AS holds FROM rows")
def q_p14(spark, d):
    holds = F.when(F.col("mode") == "rollout", F.col("t") == 4 + F.col("rollout_step") - 1).otherwise(F.col("t") == F.col("input_start") + 4)
    return V.rows(spark, d).select("mode", "t", "rollout_step", "input_start", holds.alias("holds")).distinct()


@query("q_p15", "part", "WITH f AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size || '.hdf5' AS file, 'hub/' || replace(p_brand, '#', '-') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || lower(p_type) END AS repo FROM part) SELECT p_partkey, CAST(p_partkey AS BIGINT) >= 0 AND file IS NOT NULL AS named, regexp_extract(file, '([^_]*)\\.hdf5$', 1) AS label, regexp_extract(repo, 'hub/([^-]*)-(.*)', 1) AS model, regexp_extract(repo, 'hub/([^-]*)-(.*)', 2) AS dataset FROM f")
def q_p15(spark, d):
    """Labels of files and repositories named after the parts."""
    f = V.table(spark, d, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".hdf5")).alias("file"), F.concat(F.lit("hub/"), F.translate("p_brand", "#", "-"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.lower("p_type")))).alias("repo"))
    model, dataset = Q.model_and_dataset(F.col("repo"))
    return f.select("p_partkey", F.col("file").isNotNull().alias("named"), Q.dataset_of(F.col("file")).alias("label"), model.alias("model"), dataset.alias("dataset"))


def _written_arrays(spark, d):
    """A file of arrays for each label: the embedding, a velocity on 32 points, and their second half as a scalar field."""
    at = f"{shared(spark)}/arrays"
    e = V.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("embedding"), F.col("embedding").alias("flow/velocity"), F.slice("embedding", 33, 32).alias("half"), F.element_at("embedding", 1).alias("level"))
    arrays.write_arrays(e, at, "label", "vec_id", {"embedding": (64,), "flow/velocity": (32, 2), "half": (32,), "level": ()})
    return at


_PLACED = "p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings), f AS (SELECT CAST(label AS VARCHAR) || '-' || (pos // 256) || '.npz' AS file, pos % 256 AS t, embedding FROM p), m AS (SELECT file, t, 'embedding' AS name, '64' AS shape, embedding AS v FROM f UNION ALL SELECT file, t, 'flow/velocity', '32,2', embedding FROM f UNION ALL SELECT file, t, 'half', '32', embedding[33:] FROM f UNION ALL SELECT file, t, 'level', '', embedding[1:1] FROM f)"
_STAT = "u AS (SELECT file, t, name, shape, unnest(v) AS x FROM m), st AS (SELECT file, t, name, shape, avg(CAST(x AS DOUBLE)) AS mean, var_samp(CAST(x AS DOUBLE)) AS var FROM u GROUP BY ALL)"


@query("q_s7", "embeddings", f"WITH {_PLACED}, {_STAT} SELECT file, name, t, shape, {S('mean', 4)} AS mean FROM st")
def q_s7(spark, d):
    """Vectors written as arrays by the executors and read back by slices, of which neighbours share a task."""
    back = arrays.frames(spark, _written_arrays(spark, d), frames=32)
    return _array_stats(back, "values").select(F.substring_index("file", "/", -1).alias("file"), "name", "t", F.concat_ws(",", F.transform("shape", lambda n: n.cast("string"))).alias("shape"), sig(F.col("mean"), 4).alias("mean"))


@query("q_s8", "embeddings", f"WITH {_PLACED} SELECT name, count(DISTINCT file) AS n_files, CAST(count(*) AS BIGINT) AS n_frames, CAST(NULL AS VARCHAR) AS missing FROM m WHERE name <> 'level' GROUP BY name UNION ALL SELECT name || '?', count(DISTINCT file), CAST(count(*) AS BIGINT), 'pressure' FROM m WHERE name IN ('flow/velocity', 'half') GROUP BY name")
def q_s8(spark, d):
    """Fields picked without names (two axes or more), and by a leaf, a full and an unknown name."""
    c = arrays.catalogue(spark, _written_arrays(spark, d))
    count = lambda df: df.groupBy("name").agg(F.countDistinct("file").alias("n_files"), F.sum(F.element_at("shape", 1).cast("long")).alias("n_frames"))
    wanted = ["velocity", "half", "pressure"]
    gone = L.missing_fields(c, wanted).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missing"))
    named = count(L.select_fields(c, wanted)).withColumn("name", F.concat("name", F.lit("?"))).crossJoin(F.broadcast(gone))
    return count(L.select_fields(c)).withColumn("missing", F.lit(None).cast("string")).unionByName(named)


@query("q_s9", "embeddings", f"WITH {_PLACED}, {_STAT}, b AS (SELECT file, name, count(*) * CASE name WHEN 'half' THEN 32 ELSE 64 END * 8 > (SELECT quantile_disc(n, 0.5) FROM (SELECT count(*) * 64 * 8 AS n FROM f GROUP BY file) q) AS skipped FROM m WHERE name <> 'level' GROUP BY file, name) SELECT st.file, st.name, CASE WHEN skipped THEN NULL ELSE count(*) END AS n_frames, CASE WHEN NOT skipped THEN {S('max(1e-7 / (var + 1e-7))', 4)} END AS share_worst, CASE WHEN skipped THEN 'unscreened' ELSE 'well-conditioned' END AS band FROM st JOIN b USING (file, name) GROUP BY st.file, st.name, skipped")
def q_s9(spark, d):
    """Arrays above the median size of an embedding are not read; the report has them all the same."""
    at = _written_arrays(spark, d)
    c = L.select_fields(arrays.catalogue(spark, at))
    limit = R.middle(c.where("name = 'embedding'"), [], "bytes").first().low
    c = L.with_status(c, limit).withColumn("file", F.substring_index("file", "/", -1)).withColumn("key", F.concat_ws(":", "file", "name"))
    read = arrays.frames(spark, at).withColumn("key", F.concat_ws(":", F.substring_index("file", "/", -1), "name"))
    screened = read.join(c.where("status = 'screened'").select("key"), "key", "left_semi")
    n = F.size("values")
    var = _array_stats(screened, "values").select("key", (F.col("var") * n / (n - 1)).alias("var"))
    report = L.with_skipped(C.field_report(var, EPS, ["key"], medians=False).select("key", "n_frames", "share_worst", "band"), c, "key")
    return report.select(F.split_part("key", F.lit(":"), F.lit(1)).alias("file"), F.split_part("key", F.lit(":"), F.lit(2)).alias("name"), "n_frames", sig(F.col("share_worst"), 4).alias("share_worst"), "band")


@query("q_s10", "pages", "WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS leaf, lpad(CAST(page_id AS VARCHAR), 12, '0') AS path FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY path) AS n FROM f) SELECT page_id, CASE WHEN n = 1 THEN leaf WHEN n = 2 THEN leaf || '@' || path ELSE leaf || '@' || path || '#' || n END AS name FROM n")
def q_s10(spark, d):
    f = V.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("leaf"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"))
    return L.unique_leaves(f).select("page_id", "name")


@query("q_s11", "cells", "SELECT field, " + S("m") + " AS mean, " + S("greatest(sd, 1e-4)") + " AS std FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg({f}), 12) + 0.0 AS m, stddev_samp({f}) AS sd FROM cells" for f in FIELDS) + ") q")
def q_s11(spark, d):
    c = V.cells(spark, d).agg(*(g(f).alias(f"{n}_{f}") for f in FIELDS for n, g in (("m", lambda f: F.round(F.avg(f), 12) + 0.0), ("s", F.stddev_samp))))
    return c.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), sig(F.col(f"m_{f}")).alias("mean"), sig(F.greatest(F.col(f"s_{f}"), F.lit(1e-4))).alias("std")) for f in FIELDS))))


@query("q_s12", "conversations", "SELECT conv_id, CAST(turn AS VARCHAR) AS turn, role, CASE WHEN length(text) > 200 THEN '>200' ELSE CAST(length(text) AS VARCHAR) END AS cell, CASE WHEN length(text) <= 200 THEN CAST(length(text) AS DOUBLE) END AS value, length(text) > 200 AS censored FROM conversations WHERE text IS NOT NULL")
def q_s12(spark, d):
    """Lengths of turns published as a table of role and turn for each conversation."""
    n = F.char_length("text")
    c = V.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "role", F.when(n > 200, ">200").otherwise(n.cast("string")).alias("cell"))
    inner = c.groupBy("conv_id", "role").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "cell"))).alias("m"))
    published = inner.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "m"))).alias("m"))
    return files.melt_published(published, "m", ["role", "turn"])


@query("q_s13", "nation", "SELECT CASE WHEN n_nationkey = 0 THEN 0.0 ELSE n_nationkey / 1e9 END AS worst, CASE WHEN n_nationkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n FROM nation GROUP BY ALL")
def q_s13(spark, d):
    """A text log for each nation, read whole."""
    at = f"{shared(spark)}/logs"
    log = F.concat(F.lit("comparison of "), "n_name", F.lit("\nmaximum relative difference: "), F.col("n_nationkey").cast("string"), F.lit("e-9\nresult: "), F.when(F.col("n_nationkey") % 3 == 0, "FAIL").otherwise("PASS"))
    V.table(spark, d, "nation").select(log.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return files.read_log_verdict(spark, at).groupBy("worst", "verdict").agg(F.count("*").alias("n"))


_TWO = "a AS (SELECT l_returnflag AS k, l_linestatus AS s, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag AS k, l_linestatus AS s, sum(CASE WHEN l_tax > 0.01 THEN l_quantity ELSE 0 END) AS q, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)"


def _two(spark, d):
    li = V.table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "k", "l_linestatus": "s"})
    a = li.groupBy("k", "s").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return a, li.where("k <> 'R'").groupBy("k", "s").agg(F.sum(F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).otherwise(0)).alias("q"), F.count("*").alias("n"))


@query("q_v1", "lineitem", f"WITH {_TWO}, j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS s, a.q AS aq, b.q AS bq, a.n AS an, b.n AS bn FROM a FULL JOIN b ON b.k = a.k AND b.s = a.s) SELECT k, s, 'q' AS column, CASE WHEN an IS NULL THEN 'missing' WHEN bn IS NULL THEN 'extra' WHEN abs(aq - bq) <= 1e-4 * abs(bq) THEN 'equal' ELSE 'differs' END AS status FROM j UNION ALL SELECT k, s, 'n', CASE WHEN an IS NULL THEN 'missing' WHEN bn IS NULL THEN 'extra' WHEN an = bn THEN 'equal' ELSE 'differs' END FROM j".replace("AS column", 'AS "column"'))
def q_v1(spark, d):
    return K.compare_tables(*_two(spark, d), ["k", "s"], ["q", "n"])


@query("q_v2", "part", "SELECT p_partkey, least(" + ", ".join(f"CASE WHEN {S('p_retailprice', n)} = {S('p_retailprice', 12)} THEN {n} ELSE 12 END" for n in range(1, 13)) + ") AS digits, true AS matches FROM part")
def q_v2(spark, d):
    x, stored = F.col("p_retailprice"), F.col("stored")
    part = V.table(spark, d, "part").select("p_partkey", x, sig(x, 12).alias("stored"))
    return part.select("p_partkey", K.stated_digits(stored).alias("digits"), K.at_stated_precision(x, stored).alias("matches"))


@query("q_v3", "lineitem", f"WITH {_TWO} SELECT a.k, a.s, {S('a.q')} = {S('b.q')} AS same_q, a.n = b.n AS same_n FROM a JOIN b ON b.k = a.k AND b.s = a.s")
def q_v3(spark, d):
    a, b = _two(spark, d)
    b = b.withColumnsRenamed({"q": "bq", "n": "bn"})
    return a.join(b, ["k", "s"]).select("k", "s", (sig(F.col("q")) == sig(F.col("bq"))).alias("same_q"), (F.col("n") == F.col("bn")).alias("same_n"))


@query("q_v5", "documents", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_v5(spark, d):
    return K.required(V.docs(spark, d), V.table(spark, d, "labels"), "doc_id")


@query("q_v6", "lineitem orders", "WITH l AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS name FROM lineitem GROUP BY l_orderkey), a AS (SELECT name, count(*) AS n FROM l GROUP BY name UNION ALL SELECT 'orders with lines', count(DISTINCT l_orderkey) FROM lineitem), b AS (SELECT o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'orders with lines', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT coalesce(a.name, b.name) AS name, a.n AS observed, b.n AS expected, coalesce(a.n = b.n, false) AS pinned FROM a FULL JOIN b ON a.name = b.name")
def q_v6(spark, d):
    """Orders by the state of their lines against the states that the orders have."""
    li, orders = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    state = F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P")
    each = li.groupBy("l_orderkey").agg(state.alias("name"))
    got = each.groupBy("name").agg(F.count("*").alias("n")).unionByName(each.agg(F.count("*").alias("n")).withColumn("name", F.lit("orders with lines")))
    there = orders.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.count("*").alias("n")).withColumn("name", F.lit("orders with lines"))
    return Q.pinned(got, orders.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")).unionByName(there))


_NUM = r"nm AS (SELECT DISTINCT doc_id, CAST(printf('%.7e', CAST(s AS DOUBLE)) AS DOUBLE) AS value FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d{3,})', 1))) AS s FROM documents) q WHERE try_cast(s AS DOUBLE) IS NOT NULL AND abs(try_cast(s AS DOUBLE)) < 1e300 AND NOT (regexp_full_match(s, '\d{4}') AND CAST(s AS DOUBLE) BETWEEN 1900 AND 2099))"


@query("q_v7", "documents", f"WITH {_NUM} SELECT doc_id, value FROM nm WHERE value NOT IN (SELECT DISTINCT CAST(printf('%.7e', CAST(n_chars AS DOUBLE)) AS DOUBLE) FROM documents)")
def q_v7(spark, d):
    docs = V.table(spark, d, "documents")
    return K.untraced(K.numbers_in_text(docs, figures=8), docs.select(F.col("n_chars").cast("double").alias("value")), 8)


_CLAIMS = [("a version", r"version ([0-9]+)\b"), ("a version", r"Version ([0-9]+)\b"), ("a mail host", r"@mail([0-9]+)\.example"), ("a page", r"page ([0-9,]+)")]
_CLAIMED = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name, unnest(regexp_extract_all(text, '{p}', 1)) AS n FROM documents" for name, p in _CLAIMS)
_COUNTS = "SELECT 'a version' AS name, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS actual UNION ALL SELECT 'a mail host', (SELECT count(*) FROM region)"


@query("q_v9", "documents", f"WITH c AS ({_CLAIMED}), k AS ({_COUNTS}) SELECT DISTINCT doc_id, c.name, CAST(replace(n, ',', '') AS BIGINT) AS claimed, actual, CAST(replace(n, ',', '') AS BIGINT) = actual AS agrees FROM c LEFT JOIN k USING (name)")
def q_v9(spark, d):
    """Versions and mail hosts that documents name, held against the number of return flags and of regions."""
    flags = V.table(spark, d, "lineitem").agg(F.countDistinct("l_returnflag").alias("actual")).select(F.lit("a version").alias("name"), "actual")
    regions = V.table(spark, d, "region").agg(F.count("*").alias("actual")).select(F.lit("a mail host").alias("name"), "actual")
    return K.claims(V.docs(spark, d), _CLAIMS, flags.unionByName(regions))


@query("q_v10", "events", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE d) AS n_on_day, CAST(max(CASE WHEN d THEN floor(epoch(ts)) END) - min(CASE WHEN d THEN floor(epoch(ts)) END) AS BIGINT) AS span, (SELECT string_agg(DISTINCT CAST(CAST(x.ts AS DATE) AS VARCHAR), ',' ORDER BY CAST(CAST(x.ts AS DATE) AS VARCHAR)) FROM events x WHERE x.event_type = e.event_type AND x.user_id = e.user_id AND CAST(x.ts AS DATE) <> DATE '2024-01-10') AS outside_, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-28 12:00:00') = 0 AS none_after, user_id FROM (SELECT *, CAST(ts AS DATE) = DATE '2024-01-10' AS d FROM events) e GROUP BY event_type, user_id")
def q_v10(spark, d):
    """Records of each user and type: those of one day, the days outside of it, and whether any came after the capture."""
    return Q.bulk_window(V.table(spark, d, "events"), "2024-01-10", "2024-01-28 12:00:00", ["event_type", "user_id"]).withColumnRenamed("outside", "outside_").withColumn("outside_", F.when(F.col("outside_") != "", F.col("outside_")))


_ANCHORS = {"paper": "2023-12-20", "tables": "2024-01-05"}


@query("q_v11", "events", "WITH r AS (SELECT user_id, count(*) AS n, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY user_id), g AS (SELECT *, datediff('day', DATE '2023-12-20', a) AS p, datediff('day', DATE '2024-01-05', a) AS q FROM r) SELECT user_id, n, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, a <> b AS revised, CAST(p AS INT) AS after_paper, CAST(q AS INT) AS after_tables, (SELECT count(*) FROM g) AS n_groups, (SELECT count(DISTINCT a) = 1 FROM g) AS same_day, (SELECT bool_or(a <> b) FROM g) AS any_revised, CAST((SELECT min(p) FROM g) AS INT) AS least_after_paper, CAST((SELECT max(p) FROM g) AS INT) AS most_after_paper, CAST((SELECT min(q) FROM g) AS INT) AS least_after_tables, CAST((SELECT max(q) FROM g) AS INT) AS most_after_tables FROM g")
def q_v11(spark, d):
    """First and last day of each user, days after two anchors, and the summary over all users."""
    each = Q.chronology(V.table(spark, d, "events"), "user_id", _ANCHORS)
    named = each.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})
    return named.crossJoin(F.broadcast(Q.chronology_summary(each, _ANCHORS)))


@query("q_v12", "orders", "WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey AS page_id, CAST(k - 1 AS INT) AS place, 'v' || k AS version, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM o")
def q_v12(spark, d):
    """A page of versions for each customer, its orders; the first mark is a link, as on such pages."""
    o = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_date("o_orderdate").alias("day")))).alias("o"))
    mark = lambda x, i: F.concat(F.when(i == 0, "<a href='/v1'>[v1]</a>").otherwise(F.concat(F.lit("<b>[v"), (i + 1).cast("string"), F.lit("]</b>"))), F.lit("\n "), F.date_format(x["day"], "EEE, d MMM yyyy"), F.lit(" 10:00:00 UTC (12 KB)<br/>"))
    pages = o.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("<html><p>From: [v0] x</p>"), F.array_join(F.transform("o", mark), "\n"), F.lit("</html>")).alias("html"))
    return K.versions(pages).select("page_id", "place", "version", F.col("date").cast("string").alias("date"))


@query("q_v13", "rows", "WITH h AS (SELECT file, min(f) AS least, CAST(sum(greatest(f - 4, 0)) AS BIGINT) AS expected FROM (SELECT file, trajectory, count(DISTINCT t) AS f FROM grid GROUP BY ALL) q GROUP BY file), w AS (SELECT model, file, mode, trajectory, t, count(*) AS fields, max(rollout_step) AS step, min(n_cells) = max(n_cells) AS even, max(coalesce(pvar, 0)) AS spread FROM rows GROUP BY ALL), p AS (SELECT model, file, max(step) AS steps, count(*) FILTER (WHERE mode = 'onestep') AS windows, min(fields) = max(fields) AND bool_and(even) AS shapes_match, max(spread) = 0 AS all_zero FROM w GROUP BY ALL) SELECT model, p.file, steps, windows, expected, steps >= 13 AS long_enough, least >= 4 + steps AS frames_enough, windows = expected AS windows_complete, shapes_match, all_zero FROM p JOIN h ON h.file = p.file")
def q_v13(spark, d):
    return Q.geometry(V.rows(spark, d), V.grid(spark, d))


@query("q_v14", "documents labels", "WITH a AS (SELECT lang, source, avg(n_chars) AS v FROM documents GROUP BY ALL), b AS (SELECT lang, source, avg(length(text)) AS v FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL), j AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, CASE WHEN a.v IS NULL THEN 'missing' WHEN b.v IS NULL THEN 'extra' WHEN abs(a.v - b.v) <= 1e-4 * abs(b.v) THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.lang = b.lang AND a.source = b.source), c AS (SELECT lang, count(*) AS x, count(*) FILTER (WHERE v > 1000) AS y FROM a GROUP BY lang), s AS (SELECT lang, count(*) AS x, count(*) FILTER (WHERE v > 1000) AS y FROM b GROUP BY lang) SELECT j.lang, source, status, s.x AS n_cells, c.x AS derived_cells, s.y AS n_above, c.y AS derived_above, coalesce(s.x = c.x AND s.y = c.y, false) AS follows FROM j LEFT JOIN s ON s.lang = j.lang LEFT JOIN c ON c.lang = j.lang")
def q_v14(spark, d):
    """Two copies of a table of mean lengths, stored ones and those of the labelled texts, and counts stored with the second."""
    docs = V.table(spark, d, "documents")
    a = docs.groupBy("lang", "source").agg(F.avg("n_chars").alias("value"))
    b = docs.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("lang", "source").agg(F.avg(F.char_length("text")).alias("value"))
    stored = b.groupBy("lang").agg(F.count("*").alias("n_cells"), F.count_if(F.col("value") > 1000).alias("n_above"))
    return K.compare_tables(a, b, ["lang", "source"], ["value"]).drop("column").join(Q.derived_counts(a, stored, ["lang"], 1000), "lang")


@query("q_v15", "rows", f"WITH a AS (SELECT file, trajectory, t, field, sqrt(var * (n_cells - 1) / n_cells / (var + 1e-7)) AS x FROM rows WHERE model = 'zero' AND mode = 'onestep' AND t % 7 > 0), b AS (SELECT g.file, g.trajectory, g.t, g.field, sqrt(avg((x - m) * (x - m)) / (var_samp(x) + 1e-7)) AS y FROM grid g JOIN (SELECT file, trajectory, t, field, avg(x) AS m FROM grid GROUP BY ALL) q USING (file, trajectory, t, field) WHERE g.t >= 4 AND g.t % 5 > 0 GROUP BY ALL) SELECT coalesce(a.file, b.file) AS file, coalesce(a.trajectory, b.trajectory) AS trajectory, coalesce(a.t, b.t) AS t, coalesce(a.field, b.field) AS field, CASE WHEN a.file IS NULL THEN 'missing' WHEN b.file IS NULL THEN 'extra' WHEN x IS NULL AND y IS NULL OR abs(x - y) <= 1e-4 * abs(y) OR abs(x - y) <= 1e-12 THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b USING (file, trajectory, t, field)")
def q_v15(spark, d):
    """The score of predicting a frame's mean, from its variance and from the squared deviations; each leaves some frames out."""
    rows = V.rows(spark, d).where("model = 'zero' and mode = 'onestep' and t % 7 > 0")
    one = A.mean_predictor(rows).select(*FRAME, "field", F.col("baseline").alias("score"))
    w = Window.partitionBy(*FRAME, "field")
    dev = V.grid(spark, d).where("t >= 4 and t % 5 > 0").withColumn("_d", F.col("x") - F.avg("x").over(w))
    two = dev.groupBy(*FRAME, "field").agg(vrmse(F.avg(F.col("_d") * F.col("_d")), variance(F.col("x")), EPS).alias("score"))
    return K.compare_tables(one, two, [*FRAME, "field"], ["score"]).drop("column")


@query("q_v16", "lineitem", "WITH c AS (SELECT 'orders' AS name, CAST((SELECT count(DISTINCT l_orderkey) FROM lineitem) AS VARCHAR) AS observed, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS expected UNION ALL SELECT 'flags', CAST((SELECT count(DISTINCT l_returnflag) FROM lineitem) AS VARCHAR), '3'), s AS (SELECT *, CASE WHEN observed = expected THEN 'pass' ELSE 'fail' END AS status FROM c) SELECT *, (SELECT bool_and(status = 'pass') FROM s) AS all_pass FROM s")
def q_v16(spark, d):
    li, orders = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    one = li.agg(F.countDistinct("l_orderkey").cast("string").alias("observed")).crossJoin(orders.agg(F.count("*").cast("string").alias("expected"))).withColumn("name", F.lit("orders"))
    two = li.agg(F.countDistinct("l_returnflag").cast("string").alias("observed")).withColumns({"expected": F.lit("3"), "name": F.lit("flags")})
    return K.suite([one, two])


@query("q_v17", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def q_v17(spark, d):
    """Work that is left: keys without a written result."""
    written = V.table(spark, d, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.table(spark, d, "orders").select("o_orderkey").join(written, "o_orderkey", "left_anti")


@query("q_f1", "lineitem", f"SELECT l_orderkey, l_linenumber, {S('l_extendedprice * sqrt(2)', 3)} AS p3, {S('l_extendedprice * sqrt(2)', 6)} AS p6 FROM lineitem")
def q_f1(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sig(F.col("l_extendedprice") * F.sqrt(F.lit(2.0)), 3).alias("p3"), sig(F.col("l_extendedprice") * F.sqrt(F.lit(2.0)), 6).alias("p6"))


@query("q_f2", "embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR x > CAST(0.3 AS FLOAT))) > 0 AS exceeds FROM embeddings")
def q_f2(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | (x > F.lit(0.3).cast("float"))).alias("exceeds"))


@query("q_f3", "pages", "SELECT page_id, CASE WHEN length(html) > 2000 THEN NULL ELSE CAST(length(html) AS DOUBLE) END AS value, length(html) > 2000 AS censored FROM pages")
def q_f3(spark, d):
    n = F.char_length("html")
    label = F.when(n > 2000, ">2000").otherwise(n.cast("string"))
    return V.table(spark, d, "pages").select("page_id", label.alias("l")).select("page_id", F.col("l").try_cast("double").alias("value"), F.col("l").startswith(">").alias("censored"))


@query("q_f4", "events", "SELECT event_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS days, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS seconds FROM events")
def q_f4(spark, d):
    return V.table(spark, d, "events").select("event_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("days"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("seconds"))


@query("q_f7", "embeddings", f"WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, {S('var_pop(CAST(x AS DOUBLE))', 4)} AS var FROM e GROUP BY vec_id")
def q_f7(spark, d):
    v = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return _array_stats(v, "e").select("vec_id", sig(F.col("var"), 4).alias("var"))


@query("q_c19", "embeddings", f"WITH {_CAT} SELECT 'NOTE' AS note, string_agg(name, ',' ORDER BY name) AS fields FROM cat WHERE r > 2")
def q_c19(spark, d):
    return L.notes(L.resolve_layout(_catalogue(spark, d), 2, None))


@query("q_m10", "documents", "WITH n AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS n FROM documents) SELECT source, count(*) FILTER (WHERE n > 0) AS n_read, count(*) FILTER (WHERE n = 0) AS n_failed, CAST(sum(n) AS BIGINT) AS n_numbers, min(CASE WHEN n = 0 THEN 'ValueError: no number' END) AS error FROM n GROUP BY source")
def q_m10(spark, d):
    """Inputs without a number are recorded as failed for their source; the census of the others goes on."""
    done = M.isolated(V.table(spark, d, "documents").select("source", "text"), _numbers_of, "n_numbers bigint")
    return done.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("n_read"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum("n_numbers"), F.lit(0)).alias("n_numbers"), F.min("error").alias("error"))


def _numbers_of(row):
    found = re.findall("[0-9]+", row["text"] or "")
    if not found:
        raise ValueError("no number")
    return {"n_numbers": len(found)}


_FACTORS = "SELECT p_partkey, 'larger by a factor of ' || CASE p_size % 3 WHEN 0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) ELSE CAST(p_partkey % 100 AS VARCHAR) END || ' than before' AS text FROM part"
_KNOWN = "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS value FROM lineitem UNION SELECT DISTINCT CAST(p_size AS DOUBLE) + 0.5 FROM part"


@query("q_v8", "part", "WITH t AS (" + _FACTORS + r"), c AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(text, 'factor of ([0-9]+(?:\.[0-9]+)?)', 1))) AS claim FROM t), d AS (SELECT *, least(greatest(length(ltrim(replace(claim, '.', ''), '0')), 1), 12) AS d FROM c), k AS (" + _KNOWN + ") SELECT p_partkey, claim FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE CAST(printf('%.' || CAST(d - 1 AS VARCHAR) || 'e', value) AS DOUBLE) = CAST(claim AS DOUBLE))")
def q_v8(spark, d):
    """Claims stated for the parts, held against quantities and half sizes."""
    part, text = V.table(spark, d, "part"), F.when(F.col("p_size") % 3 == 0, F.floor("p_retailprice").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))).otherwise((F.col("p_partkey") % 100).cast("string"))
    known = V.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("value")).distinct().union(part.select(F.col("p_size").cast("double") + 0.5).distinct())
    return K.untraced_factors(part.select("p_partkey", F.concat(F.lit("larger by a factor of "), text, F.lit(" than before")).alias("text")), known, "p_partkey")


@query("q_v18", "part", r"WITH e AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS v, CAST(CAST(floor(100 * 10.0 / (p_size + 10)) AS BIGINT) + p_partkey % 3 AS BIGINT) AS c, p_size FROM part), t AS (SELECT p_partkey, p_size, v, '0.' || lpad(CAST(c AS VARCHAR), 2, '0') AS printed FROM e) SELECT p_partkey, 'floor_share(var=' || v || ', eps=10) # ' || printed AS example, printed, abs(10.0::DOUBLE / (p_size + 10.0::DOUBLE) - CAST(printed AS DOUBLE)) <= 0.5 * 0.01::DOUBLE + 1e-12 AS holds FROM t")
def q_v18(spark, d):
    """A worked example for each part, some of them with a wrong last figure."""
    cents = F.floor(F.lit(1000.0) / (F.col("p_size") + 10)) + F.col("p_partkey") % 3
    text = F.concat(F.lit("see floor_share(var="), F.col("p_size").cast("string"), F.lit(", eps=10) # 0."), F.lpad(cents.cast("string"), 2, "0"), F.lit(" as printed"))
    return K.worked_examples(V.table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey")


@query("q_v4", "events", "SELECT event_id, '/' || key AS path, CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS num FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) q")
def q_v4(spark, d):
    return K.numeric_leaves(V.table(spark, d, "events"), "props", key="event_id")


_NUMBER = r"\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d{3,}"
_V19 = rf"""WITH lf AS (SELECT {S('CAST(n_chars AS DOUBLE)', 4)} AS value, CASE WHEN doc_id % 2 = 0 THEN 'eps' ELSE 'fix' END AS floor FROM documents),
k AS (SELECT value, min(floor) AS floor FROM lf GROUP BY value HAVING min(floor) = max(floor)),
n AS (SELECT doc_id, text, regexp_extract_all(text, '{_NUMBER}') AS n, string_split_regex(text, '{_NUMBER}') AS p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, text, n[i] AS s, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(n[1:i - 1], lambda x: length(x))), 0) AS pos FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM n) q),
v AS (SELECT doc_id, {S('CAST(s AS DOUBLE)', 4)} AS value, substr(text, 1, CAST(pos AS BIGINT)) AS l, substr(text, CAST(pos AS BIGINT) + length(s) + 1) AS r FROM u),
j AS (SELECT doc_id, value, floor, l, r FROM v JOIN k USING (value)),
c AS (SELECT doc_id, value, floor, [right(l, 230), left(r, 230), list_last(string_split_regex(l, '[.!?]\s')), list_first(string_split_regex(r, '[.!?]\s'))] AS near FROM j)
SELECT DISTINCT doc_id, value, floor FROM c WHERE NOT list_bool_or(list_transform(near, lambda x: CASE floor WHEN 'eps' THEN contains(x, 'th') ELSE contains(x, 'de ') END))"""


@query("q_v19", "documents", _V19)
def q_v19(spark, d):
    """Numbers in the documents that are some document's length, which has a floor by its number, with that floor's name not near."""
    docs = V.table(spark, d, "documents")
    leaves = docs.select(F.concat(F.lit("/length/at_"), F.when(F.col("doc_id") % 2 == 0, "eps").otherwise("fix")).alias("path"), F.col("n_chars").cast("double").alias("value"))
    return K.undeclared_floors(docs.select("doc_id", "text"), leaves, {"eps": ("eps$", "th"), "fix": ("fix$", "de ")})
