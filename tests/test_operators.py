"""Hand-computed cases, undefined values, and refusals."""

import glob
import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import band, floor_share, safe_div, sig, two_sided_p, vrmse
from fieldgauge.operators import checks, frames, layout, ranks, records, scores, screen
from fieldgauge.sources import arrays, files


DATA = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scores_of_a_zero_target(spark):
    a, b = one(spark, vrmse(F.lit(1e-4), F.lit(0.0), 1e-7), vrmse(F.lit(1e-4), F.lit(0.0), 1e-5))
    assert a == pytest.approx(31.6227766) and b == pytest.approx(3.16227766) and a / b == pytest.approx(10)


def test_floor_share_and_bands(spark):
    assert one(spark, floor_share(F.lit(1e-11), 1e-7))[0] == pytest.approx(0.9999, rel=1e-6)
    assert one(spark, floor_share(F.lit(0.0), 0.0))[0] == 0.0
    with pytest.raises(ValueError):
        floor_share(F.lit(1.0), -1.0)
    assert list(one(spark, *(band(F.lit(x)).alias(str(i)) for i, x in enumerate((0.001, 0.3, 0.7, 0.95, float("nan")))))) == ["well-conditioned", "floor-sensitive", "floor-dominated", "floor-determined", "undefined"]


def test_division_and_rounding(spark):
    r = one(spark, safe_div(F.lit(1.0), F.lit(0.0)), safe_div(F.lit(0.0), F.lit(0.0)), safe_div(F.lit(-1.0), F.lit(0.0)), sig(F.lit(0.99989), 4), sig(F.lit(float("inf")), 3), sig(F.lit(None).cast("double")))
    assert r[0] == math.inf and math.isnan(r[1]) and r[2] == -math.inf and r[3] == 0.9999 and r[4] == math.inf and r[5] is None


def test_p_of_a_correlation(spark):
    assert one(spark, two_sided_p(F.lit(0.7612031631090896), F.lit(8)))[0] == pytest.approx(0.010541457064411435, rel=1e-9)
    assert one(spark, two_sided_p(F.lit(0.5), F.lit(1)))[0] == pytest.approx(2 / 3, rel=1e-9)


def test_undefined_denominators(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 0.0), ("b", 2.0), ("c", 3.0), ("d", None)], "field string, var double")
    at = {r.field: r for r in screen.field_report(df, 1e-7).collect()}
    assert at["a"].n_undefined == 1 and math.isnan(at["a"].var_min) and at["a"].band == "undefined-denominator"
    assert at["b"].n_zero == 1 and at["b"].band == "floor-determined" and at["c"].band == "well-conditioned" and at["d"].band == "undefined-denominator"
    zero = {r.field: r.band for r in screen.field_report(df, 0.0).collect()}
    assert zero == {"a": "undefined-denominator", "b": "degenerate-denominator", "c": "no-floor", "d": "undefined-denominator"}
    assert screen.verdict(screen.field_report(df, 1e-7), 1e-7).first().verdict == "SCREEN UNDEFINED"
    assert screen.clean_gate(screen.field_report(df, 1e-7)).first().clean is False


def test_last_batch_against_all(spark):
    rows = [("m", "f", t, 6 + k, None, 1e-7, v) for t, vs in ((0, (1.0, 3.0)), (1, (9.0, 11.0))) for k, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "model string, file string, trajectory int, rollout_step int, input_start int, eps double, score double")
    r = {x.label: x for x in scores.last_trajectory_counterfactual(s, scores.windows(spark)).collect()}["6-12"]
    assert r.last == 10 and r.all == 6


def test_trapezoid_and_interpolation(spark):
    p = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 10.0), ("b", 3, 7.0)], "k string, x int, y double")
    t = {r.k: r for r in scores.trapezoid(p, ["k"]).collect()}
    assert t["a"].weighted == 5 and t["b"].weighted == 7
    m = {r.k: r for r in scores.interpolated_mean(p, 0, 20, ["k"]).collect()}
    assert m["a"].n_grid == 21 and m["a"].mean == pytest.approx(np.interp(range(21), [0, 10], [0, 10]).mean()) and m["b"].mean == 7


def test_mismatch_is_an_error(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    with pytest.raises(Exception, match="different shapes"):
        frames.frame_mse(a, a.where("k = 1"), ["k"], []).collect()


@pytest.mark.parametrize("how, want", [(dict(component_axis=None), ["whole", "whole", "whole"]), (dict(component_axis="auto"), ["whole", "whole", "refused"]), (dict(component_axis=-1), ["refused"] * 3), (dict(component_axis=-1, n_leading=1), ["refused", "whole", "split"]), (dict(axes={"vector": -1, "scalar": None}), ["whole", "whole", "split"]), (dict(axes={"vector": -1}), ["whole", "refused", "split"])])
def test_layouts(spark, how, want):
    cat = spark.createDataFrame([("plain", [8, 8]), ("scalar", [5, 8, 8]), ("vector", [5, 8, 8, 2])], "name string, shape array<int>")
    got = {r.name: r.decision for r in layout.resolve_layout(cat, 2, **how).collect()}
    assert [got[n] for n in ("plain", "scalar", "vector")] == want


def test_refusal_and_absence_fail(spark):
    cat = spark.createDataFrame([("v", [5, 8, 8, 2])], "name string, shape array<int>")
    with pytest.raises(Exception, match="ambiguous"):
        layout.strict(layout.resolve_layout(cat, 2, "auto")).collect()
    keys, there = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string")
    with pytest.raises(Exception, match="absent: b"):
        checks.required(keys, there, "k", strict=True).collect()


def test_comparison_can_fail(spark):
    a = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, 0.0), (3, 1.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.00001, float("nan")), (2, 2.1, 1e-13), (4, 1.0, 1.0)], "k int, x double, y double")
    got = {(r.k, r.column): r.status for r in checks.compare_tables(a, b, ["k"], ["x", "y"]).collect()}
    assert got[1, "x"] == got[1, "y"] == got[2, "y"] == "equal" and got[2, "x"] == "differs" and got[3, "x"] == "extra" and got[4, "x"] == "missing"


def test_names_and_runs(spark):
    f = spark.createDataFrame([("x", "a/x"), ("x", "b/x"), ("x", "c/x")], "leaf string, path string")
    assert [r.name for r in layout.unique_leaves(f).orderBy("path").collect()] == ["x", "x@b/x", "x@c/x#3"]
    t = spark.createDataFrame([("k", i) for i in (1, 2, 3, 7, 8)], "k string, t int")
    assert sorted((r.first, r.last, r.n) for r in layout.runs(t, ["k"]).collect()) == [(1, 3, 3), (7, 8, 2)]


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("m", "rollout", "f.x", 0, 4, 1, None, n, i, 0.1 * i, 0.2, 0.3) for i, n in enumerate(("a", "b"))], "model string, mode string, file string, trajectory int, t int, rollout_step int, input_start int, field string, field_idx int, mse double, var double, pvar double")
    files.write_score_rows(files.as_payloads(rows), f"{tmp_path}/j", "json")
    back = files.read_score_rows(spark, f"{tmp_path}/j")
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    files.write_score_rows(rows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    files.write_windows_csv(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    census = spark.createDataFrame([("d", "f.1", "a", 1.0, 2.0, 1.5, 0.0, 0.1, 7)], "dataset string, file string, field string, var_min double, var_max double, var_mean double, frac_below_epslib double, frac_below_epsfix double, n_frames int")
    files.write_census(census, f"{tmp_path}/s")
    got = files.read_census(spark, f"{tmp_path}/s/*.json").first()
    assert (got.file, got.field, got.var_min, got.n_frames) == ("f.1", "a", 1.0, 7)


def test_arrays(spark, tmp_path):
    """Slices, `.npz` members stored and compressed, Fortran order, arrays without axes, patterns, empty folders, and refusals."""
    a = np.arange(60.0).reshape(5, 3, 4)
    os.makedirs(tmp_path / "in")
    np.save(tmp_path / "in/v.npy", a)
    np.savez(tmp_path / "in/s.npz", **{"x/u": a[:, 0], "level": np.float32(7), "none": np.zeros((0, 2))})
    np.savez_compressed(tmp_path / "in/c.npz", u=np.asfortranarray(a.astype("int16")), flag=np.array([True, False]))
    got = arrays.frames(spark, str(tmp_path / "in"), frames=2)
    rows = {(os.path.basename(r.file), r.name, r.t): (r.shape, r["values"]) for r in got.collect()}
    want = {("v.npy", "v", t): ([3, 4], a[t].ravel().tolist()) for t in range(5)} | {("s.npz", "x/u", t): ([4], a[t, 0].tolist()) for t in range(5)} | {("s.npz", "level", 0): ([], [7.0])}
    want |= {("c.npz", "u", t): ([3, 4], a[t].ravel().tolist()) for t in range(5)} | {("c.npz", "flag", t): ([], [1.0 - t]) for t in range(2)}
    assert rows == want
    assert got.rdd.getNumPartitions() == 3 + 3 + 1 + 3 + 1
    assert {r.name for r in arrays.frames(spark, str(tmp_path / "in/*.npz"), fields=["u", "level"]).collect()} == {"x/u", "level", "u"}
    cat = arrays.catalogue(spark, f"file://{tmp_path}/in")
    assert sorted((r.name, r.dtype, tuple(r.shape), r.bytes) for r in cat.collect()) == sorted([("v", "float64", (5, 3, 4), 480), ("x/u", "float64", (5, 4), 160), ("level", "float32", (), 4), ("none", "float64", (0, 2), 0), ("u", "int16", (5, 3, 4), 120), ("flag", "bool", (2,), 2)])
    assert {r.name for r in layout.select_fields(cat).collect()} == {"v", "x/u", "none", "u"}
    assert {r.name for r in layout.select_fields(cat, ["u", "level", "gone"]).collect()} == {"x/u", "u", "level"}
    assert [r.name for r in layout.missing_fields(cat, ["u", "gone"]).collect()] == ["gone"]
    os.makedirs(tmp_path / "empty")
    assert arrays.frames(spark, str(tmp_path / "empty")).count() == 0 and arrays.catalogue(spark, str(tmp_path / "empty")).count() == 0
    np.savez(tmp_path / "empty/words.npz", w=np.array(["a", "b"]))
    assert arrays.catalogue(spark, str(tmp_path / "empty")).first().dtype == "<U1"
    with pytest.raises(Exception, match="no numbers"):
        arrays.frames(spark, str(tmp_path / "empty")).collect()


def test_arrays_of_many_files(spark, tmp_path):
    """Many slices or files share tasks, large files are read by several, and every frame comes once."""
    from fieldgauge.sources.arrays import ArrayFrames

    want = {}
    os.makedirs(tmp_path / "one")
    os.makedirs(tmp_path / "many")
    long = np.arange(2000.0).reshape(500, 4)
    np.savez(tmp_path / "one/a.npz", u=long, f=np.asfortranarray(long), n=np.full(3, np.nan))
    for i in range(150):
        np.savez(tmp_path / f"many/{i}.npz", u=long[: i % 7] + i, level=np.int16(i))
        want |= {(f"{i}.npz", "u", t): long[t] + i for t in range(i % 7)} | {(f"{i}.npz", "level", 0): [i]}
    np.savez_compressed(tmp_path / "many/long.npz", v=(big := np.random.default_rng(1).random((300, 8192))), f=np.asfortranarray(big[:9, :3]))
    want |= {("long.npz", "v", t): big[t] for t in range(300)} | {("long.npz", "f", t): big[t, :3] for t in range(9)}
    one = arrays.frames(spark, str(tmp_path / "one"), frames=2)
    assert one.rdd.getNumPartitions() <= 2 * 64
    rows = sorted((r.name, r.t, r.shape, r["values"]) for r in one.where("name <> 'n'").collect())
    assert rows == sorted((name, t, [4], long[t].tolist()) for name in "fu" for t in range(500))
    assert [math.isnan(r["values"][0]) for r in one.where("name = 'n'").collect()] == [True] * 3
    many = arrays.frames(spark, str(tmp_path / "many"), frames=2)
    assert 3 < many.rdd.getNumPartitions() <= 2 * 64
    got = [((os.path.basename(r.file), r.name, r.t), r["values"]) for r in many.collect()]
    assert len(got) == len(want) and all(np.array_equal(want[k], v) for k, v in got)
    assert {r.name for r in arrays.frames(spark, str(tmp_path / "many"), fields=["level"]).collect()} == {"level"}
    cat = arrays.catalogue(spark, str(tmp_path / "many"))
    assert cat.count() == 302 and cat.rdd.getNumPartitions() <= 2 * 64
    assert max(len(p.value) for p in ArrayFrames({"path": str(tmp_path / "many")}).reader(None).partitions()) > 1


def test_written_arrays(spark, tmp_path):
    df = spark.range(10).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("f"), (-F.col("id")).alias("t"), F.when(F.col("id") != 9, F.array(F.col("id").cast("double"), F.lit(1.0))).alias("v"))
    done = arrays.write_arrays(df, str(tmp_path / "x"), "f", "t", {"v": (2,)}, per_file=4)
    assert sorted(map(tuple, done.collect())) == [("a-0.npz", 4), ("b-0.npz", 4), ("b-1.npz", 2)]
    back = sorted((os.path.basename(r.file), r.t, r["values"][0]) for r in arrays.frames(spark, str(tmp_path / "x")).collect())
    assert math.isnan(back[0][2]) and [x[2] for x in back[1:]] == [6.0, 3.0, 0.0, 8.0, 7.0, 5.0, 4.0, 2.0, 1.0]


@pytest.mark.parametrize(("shape", "axes"), [((6,), []), ((3, 4), [-1]), ((3, 4), [0]), ((2, 3, 4), [1]), ((2, 3, 4), [-1, -2]), ((2, 3, 4), [0, 2]), ((2, 1, 3, 2), [2, 1]), ((0, 3), [1])])
def test_components_on_any_axis(spark, shape, axes):
    a = np.arange(float(np.prod(shape))).reshape(shape)
    df = spark.createDataFrame([("k", "f", list(shape), a.ravel().tolist(), axes or None)], "key string, name string, shape array<int>, values array<double>, axes array<int>")
    got = {r.name: (r.shape, r["values"]) for r in layout.split_components(df).collect()}
    at = sorted(x % len(shape) for x in axes)
    want = {"f": (list(shape), a.ravel().tolist())} if not at else {}
    for index in np.ndindex(*(shape[x] for x in at)) if at else []:
        part = a[tuple(index[at.index(x)] if x in at else slice(None) for x in range(len(shape)))]
        want["f." + "".join(map(str, index))] = (list(part.shape), part.ravel().tolist())
    assert got == want


def test_components_as_decided(spark, tmp_path):
    """Arrays read, laid out by declaration and split; a layout that does not fit is refused."""
    np.savez(tmp_path / "a.npz", velocity=np.arange(24.0).reshape(2, 4, 3), density=np.arange(8.0).reshape(2, 4))
    cat = arrays.catalogue(spark, str(tmp_path))
    resolved = layout.resolve_layout(cat.select("name", "shape"), 1, -1, n_leading=1)
    parts = layout.laid_out(arrays.frames(spark, str(tmp_path)), resolved)
    assert {r.name: r.n for r in parts.groupBy("name").agg(F.count("*").alias("n")).collect()} == {"density": 2, "velocity.0": 2, "velocity.1": 2, "velocity.2": 2}
    assert parts.where("name = 'velocity.1' and t = 1").first()["values"] == [13.0, 16.0, 19.0, 22.0]
    with pytest.raises(Exception, match="neither a scalar"):
        layout.laid_out(arrays.frames(spark, str(tmp_path)), layout.resolve_layout(cat.select("name", "shape"), 2, -1, n_leading=2)).collect()
    with pytest.raises(Exception, match="axes do not fit"):
        layout.split_components(spark.createDataFrame([("f", [2], [1.0, 2.0], [1])], "name string, shape array<int>, values array<double>, axes array<int>")).collect()


def test_skipped_fields_reach_the_report(spark):
    cat = layout.with_status(spark.createDataFrame([("a", [9, 9], 648), ("b", [3, 3], 72)], "name string, shape array<int>, bytes bigint"), 100)
    report = screen.field_report(spark.createDataFrame([("b", 1.0), ("b", 2.0)], "name string, var double"), 1e-7, ["name"])
    full = {r.name: r for r in layout.with_skipped(report, cat).collect()}
    assert full["a"].band == "unscreened" and full["a"].var_min is None and full["b"].band == "well-conditioned"
    assert screen.clean_gate(report).first().clean is True
    gate = screen.clean_gate(report, layout.skip_notes(cat)).first()
    assert gate.clean is False and gate.reasons == "incomplete"


def test_incremental_census(spark, tmp_path):
    """New inputs only; a batch that is replayed after its write replaces what it left."""
    from fieldgauge.streaming import jobs

    make = lambda k: spark.createDataFrame([(k, float(i)) for i in range(4)], "k int, x double")
    run = lambda: jobs.incremental_census(spark, make(0).schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b.groupBy("k").agg(F.var_samp("x").alias("v")))
    taken = lambda: sorted(r.k for r in jobs.read_batches(spark, f"{tmp_path}/out").collect())
    for k in (1, 2):
        make(k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    assert taken() == [1, 2]
    for f in glob.glob(f"{tmp_path}/cp/commits/*1*") + glob.glob(f"{tmp_path}/cp/commits/.*1*"):
        os.remove(f)  # as if the job had failed between the write and the commit
    run()
    assert taken() == [1, 2]
    jobs.write_batch(make(9).select("k").distinct(), 1, f"{tmp_path}/out")
    jobs.write_batch(make(9).select("k").distinct(), 1, f"{tmp_path}/out")
    assert taken() == [1, 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_in_any_order(spark, tmp_path, seed):
    """Frames dealt over batches at random, with a gap, a null, other sites and two trajectories: as the batch operator."""
    from fieldgauge.streaming import jobs

    rng, rows = random.Random(seed), []
    for trajectory in (0, 1):
        for t in range(12):
            if (trajectory, t) != (0, 5):
                rows += [("f", trajectory, "u", 0, t, site, None if (t, site) == (3, 2) else rng.random()) for site in range(4) if (t + site) % 7]
    grid = spark.createDataFrame(rows, "file string, trajectory int, field string, field_idx int, t int, site int, x double")
    want = {(r.trajectory, r.t): r.persistence_mse for r in frames.persistence_mse(grid).collect() if r.persistence_mse is not None}
    folded = grid.groupBy("file", "trajectory", "field", "t").agg(F.collect_list(F.struct("site", "x")).alias("cells"))
    keys = [(r.trajectory, r.t) for r in folded.select("trajectory", "t").collect()]
    rng.shuffle(keys)
    for i in range(0, len(keys), 6):
        part = spark.createDataFrame(keys[i : i + 6], "trajectory int, t int")
        folded.join(part, ["trajectory", "t"]).select("file", "trajectory", "field", "t", "cells").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.persistence_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = [((r.trajectory, r.t), r.persistence_mse) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_rollout_calls_the_model_once_a_step(spark, tmp_path):
    from fieldgauge.streaming import jobs

    def model(inputs):
        with open(tmp_path / "calls", "a") as f:
            f.write(f"{len(inputs)}\n")
        return [sum(x) / len(x) for x in inputs]

    rows = [("f", k, t, s, float(t * 10 + s)) for k in (0, 1) for t in range(6) for s in range(5) if (k, t, s) != (1, 2, 3)]
    df = spark.createDataFrame(rows, "file string, trajectory int, t int, site bigint, x double")
    got = {(r.trajectory, r.site, r.rollout_step): r.pred for r in jobs.rollout_forecasts(df, model, 3, mean=2.0, std=4.0).collect()}
    assert len(got) == 3 * (5 + 4) and (1, 3, 1) not in got
    assert got[0, 2, 1] == pytest.approx(17) and got[0, 2, 2] == pytest.approx((12 + 22 + 32 + 17) / 4)
    assert sorted(open(tmp_path / "calls").read().split()) == ["4"] * 3 + ["5"] * 3


def test_leaves_of_any_depth(spark):
    deep = "[" * 50_000 + "7" + "]" * 50_000
    texts = ['{"a": [1, [2.5, {"b": "x 3 and -4.5"}]], "c": true, "d": null, "e": {}}', "8", '"9 lives"', "no", None, "", "[1, 2", "{}", '{"k": 1, "k": 2}', "NaN", '["1e3"]', '{"é/\\u00e9": -0.5e1}', deep, deep[:-1], deep.replace("7", '{"x": [tru]}'), deep.replace("7", '{"x": [true, {"y": "5"}], "z": 6}')]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"path": F.lit(1), "_doc": F.lit(2)})
    got = {}
    for r in checks.numeric_leaves(df, "text").collect():
        got.setdefault(r.doc_id, []).append((r.path[:200], r.num))
    want = {0: [("/a/0", 1.0), ("/a/1/0", 2.5), ("/a/1/1/b", 3.0), ("/a/1/1/b", -4.5)], 1: [("", 8.0)], 2: [("", 9.0)], 8: [("/k", 2.0)], 10: [("/0", 1.0), ("/0", 3.0)], 11: [("/é/é", -5.0)], 12: [(("/0" * 50_000)[:200], 7.0)]}
    want[15] = [(("/0" * 50_000)[:200], x) for x in (5.0, 6.0)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert plan_of(checks.numeric_leaves(df, "text")).count("Scan") == 1
    assert checks.numeric_leaves(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("text", ['{"a":[1,2,{"b":[]}],"c":"\\\\\\""}', "[]", "{}", " [1 , 2 ] ", "1", "[1,]", "[,1]", '{"a"}', '{"a":}', '{,}', "[1 2]", "]", "[}", '{"a":1,}', "[[1]", "1 2", '{1:2}', "tru", "01", "-", '"a', "[1]]", ""])
def test_own_reader_agrees(text):
    def read(f):
        try:
            return f(text)
        except ValueError:
            return "refused"

    assert read(checks._read_deep_json) == read(lambda x: json.loads(x, parse_int=float, parse_constant=checks._refused))


def test_claims_against_counts(spark):
    docs = spark.createDataFrame([(0, "MAP has 17 rows and 1,728 windows; again 17 rows"), (1, "18 rows, 99 checks"), (2, None), (3, "")], "doc_id int, text string")
    actual = spark.createDataFrame([("rows", 17), ("windows", 1728)], "name string, actual int")
    patterns = [("rows", r"(\d+) rows"), ("windows", r"([\d,]+) windows"), ("checks", r"(\d+) checks")]
    got = sorted((tuple(r) for r in checks.claims(docs, patterns, actual).collect()), key=repr)
    assert got == sorted([(0, "rows", 17, 17, True), (0, "windows", 1728, 1728, True), (1, "rows", 18, 17, False), (1, "checks", 99, None, None)], key=repr)


def test_versions_of_a_page(spark):
    html = "<b>[<a href='x'>v1</a>]</b> Mon, 3 Jan\n2022 10:00 [v2] <i>Tue,</i> 04 FEB 2023, [v3] Mon, 31 Feb 2022, [v4] no day"
    pages = spark.createDataFrame([(0, html.replace("[<a href='x'>v1</a>]", "<a href='x'>[v1]</a>")), (1, "<p>none</p>"), (2, None)], "page_id int, html string")
    got = [(r.place, r.version, str(r.date)) for r in checks.versions(pages).orderBy("place").collect()]
    assert got == [(0, "v1", "2022-01-03"), (1, "v2", "2023-02-04"), (2, "v3", "None")]


def brute_undeclared(text, leaves, floors, reach=230):
    out = set()
    for m in re.finditer(checks.NUMBER, text or ""):
        value = float(f"{float(m[0]):.3e}")
        of = {next((f for f, (seg, _) in floors.items() if re.search(seg, p)), None) for p, v in leaves if float(f"{v:.3e}") == value}
        if len(of) == 1 and None not in of:
            floor = of.pop()
            left, right = text[: m.start()], text[m.end() :]
            near = (left[-reach:], right[:reach], re.split(r"[.!?]\s", left)[-1], re.split(r"[.!?]\s", right)[0])
            if not any(re.search(floors[floor][1], x) for x in near):
                out.add((value, floor))
    return out


def test_context_of_very_many_numbers(spark):
    floors = {"eps": ("eps$", "library (?:floor|one)"), "fix": ("fix$", "raised floor")}
    rng = random.Random(3)
    leaves = [("/a/at_eps", 123.0), ("/a/at_fix", 456.0), ("/a/at_eps", 7.5), ("/b/at_none", 7.5), ("/b/x_eps", 888.0)]
    texts = ["".join(rng.choice(["123", "456.0 ", "888", "7.5", " word ", " library floor", "raised floor ", ". ", "! ", "é", " filler" * 20]) + rng.choice(["", " "]) for _ in range(60)) for _ in range(60)]
    many = "456 raised floor. " + "filler words " * 40 + ". " + "123 and 888 " * 5000
    rows = [*enumerate(texts), (98, many), (99, many + " library one"), (99, "the 123 alone"), (100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"kind": F.lit(1), "value": F.lit(0)})
    got = {(r.doc_id, r.value, r.floor) for r in checks.undeclared_floors(docs, spark.createDataFrame(leaves, "path string, value double"), floors).collect()}
    assert got == {(i, *x) for i, text in rows for x in brute_undeclared(text, leaves, floors)}


def test_claims_in_text(spark):
    t = spark.createDataFrame([(0, "larger by a factor of 2.5 or a factor of 30"), (1, "no claim"), (2, None), (3, "factor of 2.51")], "doc_id int, text string")
    known = spark.createDataFrame([(2.54,), (29.7,)], "value double")
    assert [(r.doc_id, r.claim) for r in checks.untraced_factors(t, known).collect()] == [(3, "2.51")]
    t = spark.createDataFrame([(0, "see floor_share(var=1e-7, eps=1e-7) # 0.5 and floor_share(var=3,eps=1) # 0.26"), (1, None)], "doc_id int, text string")
    assert sorted((r.printed, r.holds) for r in checks.worked_examples(t).collect()) == [("0.26", False), ("0.5", True)]


def test_undeclared_floors(spark):
    floors = {"eps": ("eps$", "library floor"), "fix": ("fix$", "raised floor")}
    leaves = spark.createDataFrame([("/a/at_eps", 12.34), ("/a/at_fix", 56.78), ("/a/at_eps", 9.87), ("/a/at_fix", 9.87)], "path string, value double")
    filler = "word " * 60
    texts = ["12.34 under the library floor.", f"12.34. {filler} library floor.", f"The library floor, {filler} gives 12.34.", "56.78 under the library floor", "9.87 alone", f"1.5 and 12.34 {filler}. 56.78 raised floor", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted((r.doc_id, r.floor) for r in checks.undeclared_floors(docs, leaves, floors).collect()) == [(1, "eps"), (3, "fix"), (5, "eps")]


def test_isolated(spark):
    def census(row):
        return {"n": 1 // row["k"]}

    df = spark.createDataFrame([(1, "a"), (0, "b"), (1, "c")], "k int, name string")
    from fieldgauge.operators.census import isolated

    assert sorted((r.name, r.n, r.error) for r in isolated(df, census, "n bigint").collect()) == [("a", 1, None), ("b", None, "ZeroDivisionError: integer division or modulo by zero"), ("c", 1, None)]


def test_rounding(spark):
    """Significant figures by the exact binary value, as C prints them."""
    from fieldgauge.functions import sig

    values = [66.955, 64.065, 0.5, 2.5, 1e-320, -1.25, 0.0, -0.0, 1e300, 123456.5, 0.15, float("inf")]
    for n in (1, 2, 4, 6):
        got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sig(F.col("v"), n).alias("s")).orderBy("i").collect()]
        assert got == [float(f"%.{n - 1}e" % v) for v in values]


def test_rounding_of_whole_ties(spark):
    """Whole numbers half way between two roundings go to the even figure, as C prints them."""
    from fieldgauge.functions import sig

    values = [48865.0, 48855.0, -12345.0, -12355.0, 25.0, 35.0, 5.0, 2.0**53 + 2, 2.0**63, -(2.0**63), 1e22, -0.0]
    for n in (1, 2, 4, 6):
        got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sig(F.col("v"), n).alias("s")).orderBy("i").collect()]
        assert got == [float(f"%.{n - 1}e" % v) for v in values]
    # a length of 48865 characters and the number 48860 in a text agree at four figures
    docs = spark.createDataFrame([(0, "48860 alone")], "doc_id int, text string")
    got = checks.undeclared_floors(docs, spark.createDataFrame([("/a/at_eps", 48865.0)], "path string, value double"), {"eps": ("eps$", "th")}).collect()
    assert [(r.doc_id, r.value, r.floor) for r in got] == [(0, 48860.0, "eps")]


def test_stated_digits(spark):
    """The least figures that give a number; the query rounds the stored number once, not where it is named."""
    from fieldgauge.plans.queries_tables import q_v2

    values = [0.0, -250.0, 1234.5, 99999999999.95, 123456789012.5, 0.1 + 0.2, 1e23, 1e-310, 5e-324, 1.7976931348623157e308, None, math.inf, math.nan]

    def least(x):
        return 12 if x is None or not math.isfinite(x) else min(n for n in range(1, 13) if float(f"%.{n - 1}e" % x) == float("%.11e" % x))

    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", checks.stated_digits(F.col("v")).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == [least(x) for x in values]
    plan = q_v2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS stored" in plan and "1.0E-300" in plan  # each count of figures is tried for numbers below it only


def test_frames_of_other_sites(spark):
    """The stream matches cells by site."""
    import pandas as pd

    from fieldgauge.streaming.jobs import _step

    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def update(self, v):
            self.held, self.exists = v, True

    cells = lambda d: [{"site": s, "x": x} for s, x in d.items()]
    state = State()
    first = next(_step(("f", 0, "x"), iter([pd.DataFrame({"t": [0, 1], "cells": [cells({1: 1.0, 2: 5.0}), cells({2: 5.0, 3: 9.0})]})]), state))
    second = next(_step(("f", 0, "x"), iter([pd.DataFrame({"t": [2, 4], "cells": [cells({3: 7.0}), cells({3: 1.0})]})]), state))
    assert first[["t", "persistence_mse"]].values.tolist() == [[1, 0.0]] and second[["t", "persistence_mse"]].values.tolist() == [[2, 4.0]]


def test_colliding_names_are_refused(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(r.name for r in layout.refuse_collisions(names).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="several fields would be named a"):
        layout.refuse_collisions(names.union(names.limit(1))).collect()


def brute_ranks(rows):
    """(group, value) -> (less, equal) with nulls least and undefined numbers largest."""
    key = lambda v: (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v)
    out = []
    for g, v in rows:
        mine = [key(x) for h, x in rows if h == g]
        out.append((g, sum(k < key(v) for k in mine), mine.count(key(v))))
    return sorted(out, key=repr)


def test_ranks_over_ranges(spark):
    """Ties over the borders of ranges, a hot value, nulls, undefined numbers, a null group, clashing names, no rows."""
    values = [None, 1.0, 2.0, 2.0, -3.5, math.inf, -math.inf, math.nan, math.nan, 0.0, -0.0]
    rows = [(g, v) for g in ("a", None) for v in values] + [("hot", 7.0)] * 200 + [("hot", float(i)) for i in range(60)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumns({"AT": F.lit(1), "first_": F.lit("x"), "N": F.lit(2)}).repartition(3)
    got = ranks.ranked(df, ["g"], "v")
    assert got.columns == [*df.columns, "first", "ties"]
    assert sorted(((r.g, r["first"], r.ties) for r in got.collect()), key=repr) == brute_ranks(rows)
    at = ranks.numbered(df, ["g"], ["v"], "Place", "size").collect()
    for g in {g for g, _ in rows}:
        mine = sorted((r for r in at if r.g == g), key=lambda r: r.Place)
        assert [r.Place for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}
        assert [r.v for r in mine if r.v is not None and not math.isnan(r.v)] == sorted(r.v for r in mine if r.v is not None and not math.isnan(r.v))
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).count() == 0 and ranks.ranked(df.limit(0), [], "v").count() == 0
    assert sorted(r.place for r in ranks.numbered(df, [], ["v"]).collect()) == list(range(len(rows)))
    mid = {r.g: (r.low, r.high) for r in ranks.middle(df.where("not isnan(v)"), ["g"], "v").collect()}
    assert mid["hot"] == (7.0, 7.0) and mid["one"] == (1.0, 1.0) and mid["a"] == (0.0, 1.0)


def test_median_of_one_group_of_ten_million(spark):
    """One group, half of it one value: no task gets more than its share, and the median is exact."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("x").alias("field"), F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.col("id") / n).alias("var"))
    placed, _ = ranks._placed(df, ["field"], ["var"])
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 0.4 * n
    r = screen.field_report(df, 1e-7).first()
    assert r.n_frames == n and r.var_median == 0.5 and r.share_median == pytest.approx(1e-7 / (0.5 + 1e-7), rel=1e-12)


def test_medians_of_few_values(spark):
    rows = [("a", 1.0), ("a", 4.0), ("b", 3.0), ("c", None), ("d", 1.0), ("d", math.nan), ("e", 0.0), ("e", 2.0), ("e", 9.0)]
    df = spark.createDataFrame(rows, "field string, var double")
    got = {r.field: r for r in screen.field_report(df, 1.0).collect()}
    assert got["a"].var_median == 2.5 and got["a"].share_median == pytest.approx((1 / 2 + 1 / 5) / 2)
    assert got["b"].var_median == 3 and math.isnan(got["c"].var_median) and math.isnan(got["d"].var_median) and got["e"].var_median == 2
    bound = {r.field: r for r in screen.sweep_bound(df, 0.0, 1.0).collect()}
    assert bound["a"].median == pytest.approx((math.sqrt(2) + math.sqrt(5 / 4)) / 2) and bound["e"].n_unbounded == 1 and bound["e"].median == pytest.approx((math.sqrt(3 / 2) + math.sqrt(10 / 9)) / 2) and "c" not in bound


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_group(spark):
    """Neither percentiles nor windows over all rows or a hot key, and one scan of a table."""
    from fieldgauge.plans import load

    queries = load()[0]
    for name in ("q_c3", "q_c11", "q_m12", "q_w29", "q_w20", "q_p3", "q_s10"):
        assert not re.search(r"percentile|Window ", plan_of(queries[name](spark, DATA))), name
    for name in ("q_m11", "q_w5", "q_w22", "q_w13"):
        assert plan_of(queries[name](spark, DATA)).count("lineitem.parquet") == 1, name


def test_pinned_counts(spark):
    a, b = (spark.createDataFrame(x, "name string, n long") for x in ([("rows", 17), ("windows", 1728), ("more", 1)], [("rows", 17), ("windows", 688), ("less", 2)]))
    got = {r.name: (r.observed, r.expected, r.pinned) for r in records.pinned(a, b).collect()}
    assert got == {"rows": (17, 17, True), "windows": (1728, 688, False), "more": (1, None, False), "less": (None, 2, False)}


def test_bulk_window_and_chronology(spark):
    rows = [("a", "2024-01-02 10:00:00"), ("a", "2024-01-02 10:00:30"), ("a", "2024-01-05 00:00:00"), ("b", "2024-01-01 00:00:00"), ("c", None)]
    df = spark.createDataFrame(rows, "repo string, s string").select("repo", F.col("s").cast("timestamp").alias("ts"))
    got = {r.repo: tuple(r)[1:] for r in records.bulk_window(df, "2024-01-02", "2024-01-04 00:00:00", ["repo"]).collect()}
    assert got == {"a": (3, 2, 30, "2024-01-05", False), "b": (1, 0, None, "2024-01-01", True), "c": (1, 0, None, "", True)}
    anchors = {"paper": "2023-12-31", "tables": "2024-01-02"}
    each = records.chronology(df, "repo", anchors)
    assert {r.repo: (str(r.first_day), r.revised, r.after_paper, r.after_tables) for r in each.collect()} == {"a": ("2024-01-02", True, 2, 0), "b": ("2024-01-01", False, 1, -1), "c": ("None", None, None, None)}
    assert tuple(records.chronology_summary(each.where("repo <> 'c'"), anchors).first()) == (2, False, True, 1, 2, -1, 0)


def test_geometry(spark):
    def rows(model, steps, starts, fields=2, cells=9, pvar=0.0):
        out = [(model, "f", "rollout", 0, 4 + k, k + 1, f, cells + (f if cells == 8 else 0), pvar) for k in range(steps) for f in range(fields)]
        return out + [(model, "f", "onestep", 0, 4 + k, None, f, cells + (f if cells == 8 else 0), pvar) for k in range(starts) for f in range(fields)]

    df = spark.createDataFrame(rows("good", 13, 16) + rows("short", 5, 16) + rows("few", 13, 15) + rows("uneven", 13, 16, cells=8) + rows("moves", 17, 16, pvar=1.0), "model string, file string, mode string, trajectory int, t int, rollout_step int, field_idx int, n_cells int, pvar double")
    got = {r.model: r for r in records.geometry(df, spark.range(20).select(F.lit("f").alias("file"), F.lit(0).alias("trajectory"), F.col("id").alias("t"))).collect()}
    g = got["good"]
    assert g.long_enough and g.frames_enough and g.windows_complete and g.shapes_match and g.all_zero and g.expected == 16
    assert not got["short"].long_enough and not got["few"].windows_complete and not got["uneven"].shapes_match
    assert not got["moves"].frames_enough and not got["moves"].all_zero


def test_copies_with_their_counts(spark):
    cells = spark.createDataFrame([("a", 11.0), ("a", 1.0), ("b", 12.0)], "k string, value double")
    stored = spark.createDataFrame([("a", 2, 1), ("b", 1, 0), ("c", 1, 0)], "k string, n_cells long, n_above long")
    assert {r.k: r.follows for r in records.derived_counts(cells, stored, ["k"], 10.0).collect()} == {"a": True, "b": False, "c": False}


def test_equivalence_of_two_legs(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, math.nan), ("y", 1, 2.0), ("z", 1, 1.0), ("z", 2, 1.0), ("u", 1, math.nan)], "k string, t int, mse double")
    b = spark.createDataFrame([("x", 1, 1.0), ("x", 2, math.nan), ("y", 1, 3.0), ("z", 1, 1.0), ("z", 3, 1.0), ("u", 1, 1.0)], "k string, t int, mse double")
    got = {r.k: (r.n_windows, r.n_compared, r.complete, r.worst, r.worst_relative, r.identical) for r in records.equivalence(a, b, ["k", "t"], ["k"]).collect()}
    assert got == {"x": (2, 2, True, 0.0, 0.0, True), "y": (1, 1, True, 1.0, 0.5, False), "z": (3, 1, False, 0.0, 0.0, False), "u": (1, 1, True, math.inf, math.inf, False)}


def test_labels_of_names(spark):
    df = spark.createDataFrame([("a/b_c_rayleigh.hdf5", "hub/FNO-shear-flow"), ("plain.hdf5", "one"), (None, None)], "file string, repo string")
    model, dataset = records.model_and_dataset(F.col("repo"))
    assert [tuple(r) for r in df.select(records.dataset_of(F.col("file")), model, dataset).collect()] == [("rayleigh", "FNO", "shear-flow"), ("plain", "one", None), (None, None, None)]


def test_curves_and_tables_by_step(spark):
    rows = [("m", "f", k, s, 1e-7, float(10 * k + s)) for k in (0, 1) for s in (1, 2)] + [("m", "f", 0, 1, 1e-5, 0.5)]
    s = spark.createDataFrame(rows, "model string, file string, trajectory int, rollout_step int, eps double, score double")
    got = {(r.eps, r.rollout_step): (r.last, r["all"], r.least, r.most) for r in scores.last_trajectory_curves(s).collect()}
    assert got == {(1e-7, 1): (11.0, 6.0, 1.0, 11.0), (1e-7, 2): (12.0, 7.0, 2.0, 12.0), (1e-5, 1): (0.5, 0.5, 0.5, 0.5)}
    two = {r.rollout_step: (r.at_eps, r.at_fix, r.ratio) for r in scores.two_floors(s.withColumnRenamed("score", "y"), "rollout_step").collect()}
    assert two == {1: (6.0, 0.5, 12.0), 2: (7.0, None, None)}


def test_census_documents_tell_their_run(spark, tmp_path):
    census = spark.createDataFrame([("d", f, "a", 1.0, 2.0, 1.5, 0.0, 0.1, 7) for f in ("f.1", "f.2")], "dataset string, file string, field string, var_min double, var_max double, var_mean double, frac_below_epslib double, frac_below_epsfix double, n_frames int")
    files.write_census(census, f"{tmp_path}/s", {"window": (4, 33), "stride": 2, "eps_lib": 1e-7, "eps_fix": 1e-5})
    r = spark.read.schema(files.CENSUS).json(f"{tmp_path}/s").first()
    assert (r.n_test_files_total, r.files_censused, r.window_frames, r.frame_stride, r.eps_lib, r.eps_fix) == (2, ["f.1", "f.2"], [4, 33], 2, 1e-7, 1e-5)
    assert files.read_census(spark, f"{tmp_path}/s").count() == 2
