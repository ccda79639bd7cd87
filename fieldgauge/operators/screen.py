"""The conditioning screen: how much of a denominator its floor supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.functions import INF, NAN, band, finite, floor_share, safe_div
from fieldgauge.operators import ranks as R
from fieldgauge.sources.files import written

SPAN_LIMIT = 1e6


def _with_rule(undefined: Column, value: Column) -> Column:
    """A statistic is NaN once any of its frames is undefined."""
    return F.when(undefined > 0, NAN).otherwise(value)


def field_report(var: DataFrame, eps: float, by: list[str] = ("field",), medians: bool = True) -> DataFrame:
    """One row for each field from its frame denominators `var`: counts, spread, shares and band.

    A denominator that is null, NaN or infinite is undefined and makes the field's statistics NaN. ``medians``
    adds `var_median` and `share_median`: exact ones, from the two middle denominators (the share falls as the
    denominator grows, so these are its middle ones too); for that
    they are written and sorted, all else is one aggregation.
    """
    v, share = F.col("var"), floor_share(F.col("var"), eps)
    var = written(var.select(*by, "var")) if medians else var
    ok = finite(v)
    good = F.when(ok, v)
    n, bad = F.count("*"), F.count_if(~ok)
    zeros = F.count_if(ok & (v <= 0))
    low = F.min(F.when(ok & (v > 0), v))
    at_floor = F.count_if(ok & (v <= eps))
    out = var.groupBy(*by).agg(
        n.alias("n_frames"),
        bad.alias("n_undefined"),
        zeros.alias("n_zero"),
        _with_rule(bad, F.min(good)).alias("var_min"),
        _with_rule(bad, F.max(good)).alias("var_max"),
        _with_rule(bad, F.max(F.when(ok, share))).alias("share_worst"),
        F.max(F.when(ok, share)).alias("share_worst_finite"),
        at_floor.alias("n_at_floor"),
        (at_floor / n).alias("frac_at_floor"),
        F.count_if(ok & (share >= 0.9)).alias("n_determined"),
        F.when(zeros > 0, INF).otherwise(safe_div(F.max(good), F.min(good))).alias("span"),
        F.coalesce(1 / F.sqrt(low), F.lit(INF)).alias("amplification"),
        F.max(good).alias("finite_max"),
        low.alias("positive_min"),
    )
    wide = (F.col("span") >= SPAN_LIMIT) | (F.col("amplification") >= SPAN_LIMIT)
    named = F.when(F.col("n_undefined") > 0, "undefined-denominator")
    if eps == 0:
        named = named.when(F.col("n_zero") > 0, "degenerate-denominator").when(wide, "floorless-unbounded").otherwise("no-floor")
    else:
        named = named.otherwise(band(F.col("share_worst")))
    out = out.withColumn("band", named)
    if not medians:
        return out
    each = R.with_medians(out, var, list(by), "var")
    low, high = F.col("_low"), F.col("_high")
    middle = {"var_median": R.median(low, high), "share_median": R.median(floor_share(high, eps), floor_share(low, eps))}
    return each.withColumns({c: _with_rule(F.col("n_undefined"), m) for c, m in middle.items()}).drop("_low", "_high")


def rescued(report: DataFrame) -> DataFrame:
    """Without a floor, fields whose scales differ too much with each other's are unbounded too."""
    over = report.agg(safe_div(F.max("finite_max"), F.min("positive_min")).alias("cross_span"))
    return report.crossJoin(F.broadcast(over)).withColumn("band", F.when((F.col("band") == "no-floor") & (F.col("cross_span") >= SPAN_LIMIT), "floorless-unbounded").otherwise(F.col("band")))


def least_conditioned(report: DataFrame, order: str = "field_idx") -> DataFrame:
    """The field of the largest finite share, the first of equals; 0 and undefined shares rank last."""
    s = F.col("share_worst")
    rank = F.when(finite(s) & (s != 0), s).otherwise(-1.0)
    return report.withColumn("_r", F.row_number().over(Window.orderBy(rank.desc(), order))).where("_r = 1").drop("_r")


def verdict(report: DataFrame, eps: float) -> DataFrame:
    """The report's verdict: undefined over no floor over positive, borderline and negative."""
    worst = F.max(F.when(finite(F.col("share_worst")), F.col("share_worst")))
    bad = F.max(F.when(F.col("band") == "undefined-denominator", 1).otherwise(0))
    named = F.when(bad == 1, "SCREEN UNDEFINED")
    named = named.otherwise("NO FLOOR") if eps == 0 else named.when(worst >= 0.9, "SCREEN POSITIVE").when(worst >= 0.5, "SCREEN BORDERLINE").otherwise("SCREEN NEGATIVE")
    return report.agg(named.alias("verdict"), worst.alias("worst_share"), F.count("*").alias("n_fields"))


def clean_gate(report: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Why a report is not clean: positive, degenerate, undefined, floorless, incomplete; none: clean."""
    has = lambda *names: F.max(F.when(F.col("band").isin(*names), 1).otherwise(0)) == 1
    flags = report.agg(has("floor-determined").alias("p"), has("degenerate-denominator").alias("d"), has("undefined-denominator").alias("u"), has("floorless-unbounded").alias("f"))
    flags = flags.crossJoin(F.broadcast(notes.agg((F.count_if(F.col("grade") == "assumed") > 0).alias("i")))) if notes is not None else flags.withColumn("i", F.lit(False))
    reasons = F.array_compact(F.array(*(F.when(F.col(c), F.lit(n)) for c, n in zip("pdufi", ("positive", "degenerate", "undefined", "floorless", "incomplete"), strict=True))))
    return flags.select(F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("clean"))


def sweep_scores(rows: DataFrame, floors: list[float], by: list[str]) -> DataFrame:
    """Mean score at each floor, and the largest over the least of the finite positive ones."""
    each = rows.select(*by, "mse", "var", F.explode(F.array(*map(F.lit, floors))).alias("eps"))
    mean = each.groupBy(*by, "eps").agg(F.avg(F.sqrt(safe_div(F.col("mse"), F.col("var") + F.col("eps")))).alias("score"))
    ok = F.when(finite(F.col("score")) & (F.col("score") > 0), F.col("score"))
    w = Window.partitionBy(*by)
    return mean.withColumn("span", safe_div(F.max(ok).over(w), F.min(ok).over(w)))


def sweep_bound(var: DataFrame, low: float, high: float, by: list[str] = ("field",)) -> DataFrame:
    """How much a score can change between two floors, from the denominators alone."""
    r = F.sqrt(safe_div(F.col("var") + high, F.col("var") + low))
    ratios = written(var.where(F.col("var").isNotNull()).select(*by, r.alias("_r")))
    ok = F.when(finite(F.col("_r")), F.col("_r"))
    out = ratios.groupBy(*by).agg(F.min(ok).alias("least"), F.max(ok).alias("most"), F.count_if(~finite(F.col("_r"))).alias("n_unbounded"))
    return R.with_medians(out, ratios, list(by), "_r").select(*by, "least", R.median(F.col("_low"), F.col("_high")).alias("median"), "most", "n_unbounded")


def static_fields(grid: DataFrame, tol: float = 0.0) -> DataFrame:
    """Fields that are zero everywhere, or whose last frame equals the first at every site."""
    site = grid.groupBy("file", "trajectory", "field", "site").agg(F.count_if(F.col("x") != 0).alias("nz"), F.min_by("x", "t").alias("first"), F.max_by("x", "t").alias("last"))
    return site.groupBy("file", "trajectory", "field").agg((F.sum("nz") == 0).alias("all_zero"), F.bool_and(F.abs(F.col("last") - F.col("first")) <= tol).alias("returns"))
