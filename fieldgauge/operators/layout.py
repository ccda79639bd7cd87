"""Frames, components and layouts of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.operators import ranks as R


def frame_window(df: DataFrame, lo: int, hi: int, stride: int) -> DataFrame:
    """Frames lo, lo + stride, ... up to hi or the last frame that a trajectory has; a null t is no frame."""
    return df.where(F.col("t").between(lo, hi) & ((F.col("t") - lo) % stride == 0))


def even_pick(names: DataFrame, col: str, n: int) -> DataFrame:
    """n of the sorted names, evenly spread, ends included; places are rounded half to even."""
    ranked = R.numbered(names.select(col).distinct(), [], [col], "_i", "_n")
    # name i is picked if some k of the n gives it
    of = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / max(n - 1, 1), 0).cast("bigint"))
    return ranked.where(F.array_contains(of, F.col("_i"))).select(col)


def _without(shape: Column, axis: Column) -> Column:
    return F.concat(F.slice(shape, F.lit(1), axis), F.slice(shape, axis + 2, F.size(shape)))


def _product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: a * n)


def take(values: Column, shape: Column, axis: Column, at: Column) -> Column:
    """The values of a flat array (C order) whose index along ``axis`` is ``at``: slices, joined."""
    stride = _product(F.slice(shape, axis + 2, F.size(shape))).cast("int")
    block = stride * F.get(shape, axis)
    outer = (F.size(values) / F.greatest(block, F.lit(1))).cast("int")
    starts = F.when(outer > 0, F.sequence(F.lit(0), outer - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda o: F.slice(values, o * block + at * stride + 1, stride)))


def split_components(fields: DataFrame, axes: str = "axes", most: int = 2) -> DataFrame:
    """One row for each component of each field (name, shape, values flat in C order, `axes`: its component axes).

    A vector's components are named `name.i`, a tensor's `name.ij`; ``axes`` are distinct, counted from 0 or from the end (-1: the
    last), null or empty for a scalar, which stays whole under its name. More than ``most`` axes, or one that the shape has not, is an
    error. The axes that are split leave the shape. Each value is moved once for each axis.
    """
    own = [c for c in fields.columns if c not in ("name", "shape", "values", axes)]
    rank = F.size("shape")
    fits = lambda a: (a >= -rank) & (a < rank)
    asked = F.coalesce(F.col(axes), F.array().cast("array<int>"))
    checked = F.when((F.size(asked) > most) | ~F.forall(asked, fits), F.raise_error(F.concat(F.lit("axes do not fit: "), "name")).cast("array<int>")).otherwise(F.array_sort(F.transform(asked, lambda a: F.pmod(a, rank))))
    at = fields.select(*own, "name", "shape", "values", checked.alias("_axes"), F.lit(".").alias("_dot"))
    for _ in range(most):
        axis = F.get("_axes", F.lit(0))

        def part(c: Column) -> Column:
            return F.struct(F.concat("name", "_dot", c.cast("string")).alias("name"), _without(F.col("shape"), axis).alias("shape"), take(F.col("values"), F.col("shape"), axis, c).alias("values"), F.transform(F.slice("_axes", 2, most), lambda a: a - 1).alias("_axes"), F.lit("").alias("_dot"))

        whole = F.array(F.struct("name", "shape", "values", "_axes", "_dot"))
        n = F.get("shape", axis)
        parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), part)).otherwise(F.filter(whole, lambda x: F.lit(False)))
        at = at.select(*own, F.inline(F.when(F.size("_axes") == 0, whole).otherwise(parts)))
    return at.select(*own, "name", "shape", "values")


def laid_out(frames: DataFrame, resolved: DataFrame) -> DataFrame:
    """Frames (name, shape without the leading axis, values) split as `resolve_layout` has decided for their arrays.

    ``resolved`` has one row for each name, with the axis counted in the whole array. A refused field is an error when it is
    read; so is a split along the leading axis, which holds the frames. Fields without a decision are left out.
    """
    inside = F.when(F.col("axis") < 0, F.col("axis")).otherwise(F.col("axis") - 1)
    fits = (F.col("axis") >= -F.size("shape")) & (F.col("axis") != 0)
    wanted = strict(resolved).select("name", F.when(F.col("decision") == "split", F.when(fits & (F.size("shape") > 1), F.array(inside)).otherwise(F.raise_error(F.concat(F.lit("no axis for components: "), "name")).cast("array<int>"))).alias("_split"))
    return split_components(frames.join(wanted, "name").withColumnRenamed("_split", "axes"))


def leaf(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def select_fields(catalogue: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The catalogue's fields that are asked for, by full or leaf name; without names all of two axes or more."""
    if wanted is None:
        return catalogue.where(F.size("shape") >= 2)
    return catalogue.where(F.col("name").isin(wanted) | leaf(F.col("name")).isin(wanted))


def missing_fields(catalogue: DataFrame, wanted: list[str]) -> DataFrame:
    """Names that are asked for and that no field has, as full or leaf name."""
    spark = catalogue.sparkSession
    names = catalogue.select(F.explode(F.array("name", leaf(F.col("name")))).alias("name"))
    return spark.createDataFrame([(w,) for w in wanted], "name string").join(names, "name", "left_anti")


def with_status(catalogue: DataFrame, most_bytes: int) -> DataFrame:
    """Adds `status`: fields above the limit are `unscreened`, a skip that the report has to carry."""
    return catalogue.withColumn("status", F.when(F.col("bytes") > most_bytes, "unscreened").otherwise("screened"))


def with_skipped(report: DataFrame, catalogue: DataFrame, key: str = "name") -> DataFrame:
    """The report with a row for each field that was not screened: its statistics are null, its band `unscreened`."""
    skipped = catalogue.where("status = 'unscreened'").select(key).distinct()
    return report.unionByName(skipped.withColumn("band", F.lit("unscreened")), allowMissingColumns=True)


def skip_notes(catalogue: DataFrame) -> DataFrame:
    """Notes (name, grade) of skipped fields: a report without a field that was asked for is incomplete, as with an assumed layout."""
    return catalogue.where("status = 'unscreened'").select("name", F.lit("assumed").alias("grade"))


def resolve_layout(catalogue: DataFrame, n_spatial: int, component_axis=None, n_leading: int | None = None, axes: dict | None = None) -> DataFrame:
    """Adds to each field (name, shape) its decision: split on an axis, whole, or refused, and how sure that is.

    ``axes`` maps field names to an axis or None; ``n_leading`` with ``component_axis`` declares a layout;
    ``component_axis`` None screens whole, "auto" assumes it where rank allows, and a bare axis is refused.
    `grade` is asserted, assumed or null.
    """
    rank = F.size("shape")
    room = rank > n_spatial
    none, text = F.lit(None), lambda s: F.lit(s)
    axis_ok = lambda ax: (F.lit(ax) >= -rank) & (F.lit(ax) < rank) & (rank - 1 >= n_spatial)
    if axes is not None:
        axis, refusal, grade = none.cast("int"), F.when(room & ~F.col("name").isin(list(axes)), text("its rank leaves it ambiguous")), F.when(room, text("asserted"))
        for name, ax in axes.items():
            if ax is not None:
                here = F.col("name") == name
                refusal = F.when(here & ~axis_ok(ax), text("the axis does not fit")).otherwise(refusal)
                axis, grade = F.when(here, F.lit(ax)).otherwise(axis), F.when(here, none.cast("string")).otherwise(grade)
    elif n_leading is not None:
        if n_leading < 0 or component_axis in ("auto", None):
            raise ValueError("leading axes are declared together with the component axis")
        vector, scalar = rank == n_leading + n_spatial + 1, rank == n_leading + n_spatial
        axis = F.when(vector, F.lit(int(component_axis)))
        refusal = F.when(~vector & ~scalar, text("its rank is neither a scalar's nor a vector's")).when(vector & ~axis_ok(int(component_axis)), text("the axis does not fit"))
        grade = F.when(scalar, text("assumed"))
    elif component_axis is None:
        axis, refusal, grade = none.cast("int"), none.cast("string"), F.when(room, text("asserted"))
    elif component_axis == "auto":
        axis, refusal, grade = none.cast("int"), F.when(rank > n_spatial + 1, text("its rank leaves it ambiguous")), F.when(room, text("assumed"))
    else:
        axis, refusal, grade = none.cast("int"), text("an axis without a layout"), none.cast("string")
    decision = F.when(refusal.isNotNull(), "refused").when(axis.isNotNull(), "split").otherwise("whole")
    return catalogue.withColumns({"decision": decision, "axis": F.when(refusal.isNull(), axis), "grade": F.when(refusal.isNull(), grade), "refusal": refusal})


def strict(resolved: DataFrame) -> DataFrame:
    """The same, but a refused field is an error when it is read."""
    return resolved.withColumn("decision", F.when(F.col("refusal").isNotNull(), F.raise_error(F.concat_ws(": ", "name", "refusal"))).otherwise(F.col("decision")))


def collisions(names: DataFrame) -> DataFrame:
    """Names that more than one field would have."""
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def refuse_collisions(names: DataFrame) -> DataFrame:
    """The names, each once; one that more than one field would have is an error that says so."""
    each = names.groupBy("name").agg(F.count("*").alias("n"))
    return each.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several fields would be named "), F.col("name")))).otherwise(F.col("name")).alias("name"))


def history_windows(frames: DataFrame, keys: list[str], history: int = 4, stride: int = 1, cap: int | None = None) -> DataFrame:
    """start, inputs (the `history` values before the target) and target of each window of a trajectory."""
    w = Window.partitionBy(*keys).orderBy("t")
    at = frames.withColumns({"inputs": F.collect_list("x").over(w.rowsBetween(-history, -1)), "start": F.col("t") - history}).where((F.size("inputs") == history) & (F.col("start") % stride == 0))
    if cap is not None:
        at = at.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
    return at.withColumnRenamed("x", "target")


def flatten_channels(inputs: Column, fields: list[str]) -> Column:
    """A window's frames (structs of fields) as channels: frames in time, fields within a frame (P10)."""
    return F.flatten(F.transform(inputs, lambda f: F.array(*(f[c] for c in fields))))


def runs(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous runs of frame numbers: first, last and length."""
    w = Window.partitionBy(*keys).orderBy("t")
    return frames.select(*keys, "t").distinct().withColumn("g", F.col("t") - F.row_number().over(w)).groupBy(*keys, "g").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).drop("g")


def unique_leaves(fields: DataFrame) -> DataFrame:
    """A later field with a leaf name that is taken gets `leaf@path`, and a number from the third on."""
    return R.numbered(fields, ["leaf"], ["path"], "_n").withColumn("_n", F.col("_n") + 1).withColumn("name", F.when(F.col("_n") == 1, F.col("leaf")).when(F.col("_n") == 2, F.concat_ws("@", "leaf", "path")).otherwise(F.concat(F.concat_ws("@", "leaf", "path"), F.lit("#"), F.col("_n")))).drop("_n")


def notes(resolved: DataFrame) -> DataFrame:
    """INCOMPLETE with the fields whose layout was assumed, NOTE with those where it was asserted."""
    named = F.when(F.col("grade") == "assumed", "INCOMPLETE").when(F.col("grade") == "asserted", "NOTE")
    return resolved.where("grade is not null").groupBy(named.alias("note")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("fields"))
