"""Comparison of tables, provenance of numbers, and check suites."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.functions import finite, shown, sig


def compare_tables(got: DataFrame, want: DataFrame, keys: list[str], values: list[str], rel: float = 1e-4) -> DataFrame:
    """key, column and status (equal, differs, missing, extra): whole numbers and zero nearly exactly, else relative."""
    a = got.select(*keys, *(F.col(c).cast("double").alias(f"_a_{c}") for c in values), F.lit(True).alias("_a"))
    b = want.select(*keys, *(F.col(c).cast("double").alias(f"_b_{c}") for c in values), F.lit(True).alias("_b"))
    j = a.join(b, keys, "full")

    def same(x: Column, y: Column) -> Column:
        near = F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).when((x == 0) | (y == 0), F.abs(x - y) <= 1e-12).otherwise(F.abs(x - y) <= rel * F.abs(y))
        return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)

    each = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(same(F.col(f"_a_{c}"), F.col(f"_b_{c}")), "equal").otherwise("differs").alias("status")) for c in values))
    return j.select(*keys, F.inline(each))


def stated_digits(x: Column) -> Column:
    """The least number of significant figures, 1 to 12, that gives the value; 12 for null, NaN and infinities."""
    x = x.cast("double")
    # what twelve figures show, less closing zeros: fewer figures give another number, more give the same
    figures = F.length(F.rtrim(F.translate(F.split_part(shown(x, 12), F.lit("E"), F.lit(1)), "-.", ""), F.lit("0")))
    # numbers so small have fewer than twelve figures, so different ones may be one double
    fits = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda n: sig(x, n) == sig(x, 12))
    return F.when(~finite(x), F.lit(12)).when((x != 0) & (F.abs(x) < 1e-300), F.coalesce(F.array_min(fits), F.lit(12))).otherwise(F.greatest(figures, F.lit(1)))


def at_stated_precision(x: Column, stored: Column) -> Column:
    """Whether x, rounded to the figures that the stored value carries, equals it."""
    return F.coalesce(sig(x, stated_digits(stored)) == stored, F.lit(False))


#: Numbers in prose: decimals, exponents, and whole numbers of three digits or more.
NUMBER = r"\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d{3,}"


def numbers_in_text(docs: DataFrame, text: str = "text", figures: int = 4) -> DataFrame:
    """doc_id and value (to so many significant figures) of each number; years do not count."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({NUMBER})"), 1))).alias("s"))
    value = F.col("s").try_cast("double")
    return found.where(value.isNotNull() & (F.abs(value) < 1e300) & ~(F.col("s").rlike("^\\d{4}$") & value.between(1900, 2099))).select("doc_id", sig(value, figures).alias("value"))


def untraced(numbers: DataFrame, known: DataFrame, figures: int = 4) -> DataFrame:
    """Numbers that no known value gives at so many significant figures."""
    return numbers.distinct().join(known.select(sig(F.col("value"), figures).alias("value")).distinct(), "value", "left_anti")


def suite(checks: list[DataFrame]) -> DataFrame:
    """Checks (name, observed, expected) in one table with their status and whether all pass."""
    all_ = reduce(DataFrame.unionByName, checks).withColumn("status", F.when(F.col("observed").eqNullSafe(F.col("expected")), "pass").otherwise("fail"))
    return all_.crossJoin(F.broadcast(all_.agg(F.bool_and(F.col("status") == "pass").alias("all_pass"))))


def required(keys: DataFrame, present: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Keys that are absent; with ``strict`` reading an absent key is an error that names it."""
    gone = keys.select(key).distinct().join(present.select(key), key, "left_anti")
    return gone.withColumn(key, F.raise_error(F.concat(F.lit("absent: "), F.col(key).cast("string"))).cast(dict(keys.dtypes)[key])) if strict else gone


_IN_TEXT = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null)|$)')
LEAF_ROWS = 20_000  # rows of leaves that are handed on at once


def _refused(name: str):
    raise ValueError(name)


def _read_json(text: str):
    """The value of a JSON text; ValueError if it is none. Numbers are floats."""
    try:
        return json.loads(text, parse_int=float, parse_constant=_refused)
    except RecursionError:
        return _read_deep_json(text)


def _read_deep_json(text: str):
    """The same for any depth: open containers are on a list of our own."""
    at, open_, value, done = 0, [], None, False
    expects = "value"  # or: end (of a container's entry), key, colon, first (entry or end of a container)
    while True:
        m = _TOKEN.match(text, at)
        if m is None or (m.end() == at and at < len(text)):
            raise ValueError("no JSON")
        at, (sign, string, number, word) = m.end(), m.groups()
        if not any((sign, string, number, word)):
            if done and not open_:
                return value
            raise ValueError("it ends early")
        if done and not open_:
            raise ValueError("more follows")
        if expects in ("value", "first") and (string or number or word or sign in ("{", "[")) and not (expects == "first" and isinstance(open_[-1][0], dict)):
            made = {} if sign == "{" else [] if sign == "[" else json.loads(string) if string else float(number) if number else {"true": True, "false": False, "null": None}[word]
            if not open_:
                value, done = made, True
            elif isinstance(open_[-1][0], dict):
                open_[-1][0][open_[-1][1]] = made
            else:
                open_[-1][0].append(made)
            expects = "end"
            if sign:
                open_.append([made, None])
                expects = "first"
        elif expects in ("first", "key") and string and isinstance(open_[-1][0], dict):
            open_[-1][1], expects = json.loads(string), "colon"
        elif expects == "colon" and sign == ":":
            expects = "value"
        elif expects == "end" and sign == "," and open_:
            expects = "key" if isinstance(open_[-1][0], dict) else "value"
        elif expects in ("end", "first") and open_ and sign == ("}" if isinstance(open_[-1][0], dict) else "]"):
            open_.pop()
            expects = "end"
        else:
            raise ValueError(f"no {sign or string or number or word} here")


def _leaves(text: str) -> Iterator[tuple[str, float]]:
    todo = [("", _read_json(text))]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{path}/{k}", x) for k, x in v.items())
        elif isinstance(v, list):
            todo.extend((f"{path}/{k}", x) for k, x in enumerate(v))
        elif isinstance(v, float):
            yield path, v
        elif isinstance(v, str):
            yield from ((path, float(x)) for x in _IN_TEXT.findall(v))


def numeric_leaves(docs: DataFrame, col: str, key: str = "doc_id") -> DataFrame:
    """key, path and num of the numbers in JSON documents of any depth, also those inside string leaves (V4).

    One pass over the documents: each is walked once in its task, without recursion, and its leaves are handed on in batches.
    A path joins keys and places of arrays with slashes; a document that is one number has an empty path. Text that is no JSON,
    null, and documents without numbers have no rows; of equal keys in an object the last one counts.
    """
    schema = T.StructType([docs.select(F.col(key).alias(key)).schema[key], T.StructField("path", T.StringType()), T.StructField("num", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, paths, nums = [], [], []

            def made(batch=batch) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(owner, pa.int64())), pa.array(paths, pa.string()), pa.array(nums, pa.float64())], names=schema.names)
                for x in (owner, paths, nums):
                    x.clear()
                return out

            for i, text in enumerate(batch.column("_doc")):
                try:
                    for path, num in _leaves(text.as_py() or ""):
                        owner.append(i)
                        paths.append(path)
                        nums.append(num)
                        if len(owner) >= LEAF_ROWS:
                            yield made()
                except ValueError:
                    continue
            yield made()

    return docs.select(F.col(key).alias("_key"), F.col(col).cast("string").alias("_doc")).mapInArrow(run, schema)


def claims(docs: DataFrame, patterns: list[tuple[str, str]], actual: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, claimed, actual and agrees of each count that a text claims (V9).

    ``patterns`` are rows of (name, regular expression whose first group is the number, thousands by commas allowed); several may
    have one name. ``actual`` has name and actual, the count that holds; a name without one gives null in `agrees`. All
    patterns are tried in one pass over the texts; what a text repeats counts once. Null texts claim nothing.
    """
    def stated(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(F.lit(name).alias("name"), n.alias("n")))

    each = [stated(name, pattern) for name, pattern in patterns]
    found = docs.where(F.col(text).isNotNull()).select(key, F.inline(F.array_distinct(F.concat(*each))))
    claimed = F.regexp_replace("n", ",", "").try_cast("bigint")
    joined = found.select(key, "name", claimed.alias("claimed")).where("claimed is not null").distinct().join(actual.select("name", F.col("actual").cast("bigint")), "name", "left")
    return joined.select(key, "name", "claimed", "actual", (F.col("claimed") == F.col("actual")).alias("agrees"))


#: A version mark with its day: [v2] Mon, 3 Jan 2022.
VERSION = r"\[(v[0-9]+)\]\s*[A-Za-z]{3},\s*([0-9]{1,2}\s+[A-Za-z]{3}\s+[0-9]{4})"


def versions(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, place, version and date of each version mark in the text of a page, in their order.

    Tags are taken out first, so a mark may be a link. A day that no calendar has gives a null date; pages without marks, and
    null ones, have no rows.
    """
    plain = F.regexp_replace(html, "<[^>]+>", " ")
    marks = pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(f"({VERSION.replace('(', '(?:')})"), 1)).alias("place", "mark"))
    day = F.regexp_replace(F.initcap(F.regexp_extract("mark", VERSION, 2)), r"\s+", " ")
    return marks.select(key, "place", F.regexp_extract("mark", VERSION, 1).alias("version"), F.try_to_timestamp(day, F.lit("d MMM yyyy")).cast("date").alias("date"))


#: Claims in prose: a ratio, and a worked example of a floor's share with its printed value.
FACTOR = r"factor of ([0-9]+(?:\.[0-9]+)?)"
EXAMPLE = r"floor_share\(var=([-+0-9.eE]+), ?eps=([-+0-9.eE]+)\) # ([0-9]+(?:\.[0-9]+)?)"


def untraced_factors(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and claim of each "factor of N" in a text that no known value gives at as many figures as N has.

    Trailing zeros of a whole number count as figures; a text without claims, or null, has no rows.
    """
    claims = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FACTOR), 1))).alias("claim"))
    shown = F.regexp_replace(F.regexp_replace("claim", r"\.", ""), "^0+", "")
    claims = claims.withColumns({"d": F.least(F.greatest(F.length(shown), F.lit(1)), F.lit(12)), "value": F.col("claim").cast("double")})
    each = known.select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d"), F.col("value").alias("x")).select("d", sig(F.col("x"), F.col("d")).alias("value")).distinct()
    return claims.join(each, ["d", "value"], "left_anti").select(key, "claim")


def worked_examples(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, example, printed and holds of each worked example in a text: whether it gives the printed value at its decimals."""
    found = docs.select(key, F.explode(F.regexp_extract_all("text", F.lit(f"({EXAMPLE.replace('([', '(?:[')})"), 1)).alias("example"))
    part = lambda i: F.regexp_extract("example", EXAMPLE, i)
    var, eps, printed = part(1).try_cast("double"), part(2).try_cast("double"), part(3)
    decimals = F.length(F.regexp_extract(printed, r"\.([0-9]*)", 1))
    share = F.when(eps == 0, 0.0).otherwise(F.try_divide(eps, var + eps))
    holds = F.abs(share - printed.cast("double")) <= F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + 1e-12
    return found.select(key, "example", printed.alias("printed"), F.coalesce(holds, F.lit(False)).alias("holds"))


def undeclared_floors(docs: DataFrame, leaves: DataFrame, floors: dict[str, tuple[str, str]], key: str = "doc_id", reach: int = 230, figures: int = 4) -> DataFrame:
    """key, value and floor of each number in a text that a leaf gives under one floor, with that floor named neither in
    the number's sentence nor within ``reach`` characters.

    ``leaves`` has path and value; ``floors`` maps a floor to the patterns of the last segment of its paths
    and of its names in prose. Values that occur under two floors, or under none, are exempt. A number's places and what is
    near it come from the lengths of the pieces between numbers, names and ends of sentences, so that a text of any length
    with any many numbers takes memory in proportion to it; rows that share a key are judged by themselves.
    """
    last = F.regexp_extract("path", "([^/]*)$", 1)
    of_path = F.coalesce(*(F.when(last.rlike(segment), F.lit(floor)) for floor, (segment, _) in floors.items()))
    known = leaves.select(sig(F.col("value"), figures).alias("value"), of_path.alias("floor")).groupBy("value").agg(F.min("floor").alias("floor"), F.max("floor").alias("other"), F.count_if(F.col("floor").isNull()).alias("none")).where("floor = other and none = 0").select("value", "floor")
    text = F.col("text")

    def marks(pattern: str, kind: str) -> Column:
        """What stands before each match and the match itself, piece by piece."""
        pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("match"))
        return F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("long"), F.when(F.lit(kind == "number"), x["match"]).alias("s")))

    names = {floor: re.sub(r"\((?!\?)", "(?:", name) for floor, (_, name) in floors.items()}
    events = F.concat(marks(NUMBER, "number"), marks(r"[.!?]\s", "stop"), *(marks(name, f"floor {floor}") for floor, name in names.items()))
    rows = docs.where(text.isNotNull()).select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), events.alias("_events")).select("_row", "_key", F.inline("_events"))
    # places from the lengths of the pieces; the text itself goes no further than this
    piece = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(piece)).where("long is not null").withColumn("_start", F.col("_end") - F.col("long"))
    before = Window.partitionBy("_row").orderBy("_start", "_end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy(F.desc("_start"), F.desc("_end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda kind: F.col("kind") == kind
    left = {"_stop_before": F.max(F.when(is_("stop"), F.col("_end"))).over(before), **{f"_left {f}": F.max(F.when(is_(f"floor {f}"), F.col("_start"))).over(before) for f in floors}}
    right = {"_stop_after": F.min(F.when(is_("stop"), F.col("_start"))).over(after), **{f"_right {f}": F.min(F.when(is_(f"floor {f}"), F.col("_end"))).over(after) for f in floors}}
    at = placed.withColumns(left).withColumns(right).where(is_("number"))
    lo = F.least(F.greatest(F.col("_start") - reach, F.lit(0)), F.coalesce("_stop_before", F.lit(0)))
    hi = F.greatest(F.col("_end") + reach, F.coalesce("_stop_after", F.lit(2**31 - 1)))
    named = {f: F.coalesce(F.col(f"_left {f}") >= lo, F.lit(False)) | F.coalesce(F.col(f"_right {f}") <= hi, F.lit(False)) for f in floors}
    near = at.select(F.col("_key").alias(key), sig(F.col("s").try_cast("double"), figures).alias("value"), F.array_compact(F.array(*(F.when(is_named, F.lit(f)) for f, is_named in named.items()))).alias("_named"))
    return near.join(known, "value").where(~F.array_contains("_named", F.col("floor"))).select(key, "value", "floor").distinct()
