"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

A line within `threshold` edits of another one has at least one of the other's threshold + 1 segments
unchanged, at nearly the same place. So each distinct line is put into an index under its segments, and
looks up, for each length a shorter partner can have, the substrings at the places where such a segment
can have moved to. Only keys under which different lines meet are written; what meets is verified by a
bit-parallel edit distance over the band of the threshold.

Where very many lines meet under one segment, the earliest of them is compared with all, which settles
those near it. The lines left there are cut into more segments and meet again where all but `threshold`
segments are equal, and so on with ever finer cuts.
"""

from __future__ import annotations

import json
from itertools import accumulate, combinations, groupby, pairwise, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm.common import durable, few, free_name, pick

#: Edits within which two lines are the same, and code points from which a blank line takes part.
THRESHOLD, MIN_CHARS = 2, 40
#: For ``min_chars``: every line that is not blank takes part.
ALL_LINES = 1
#: Code points of the shorter of two lines from which one edit, and then more, leave them the same: in a short line an edit says
#: something else.
ONE_EDIT, MORE_EDITS = 12, 30


def edits_allowed(n: Column, threshold: int) -> Column:
    """Edits within which two lines, the shorter of n code points, are the same."""
    return F.when(n < ONE_EDIT, 0).when(n < MORE_EDITS, min(1, threshold)).otherwise(threshold)


def _takes_part(line: Column, min_chars: int) -> Column:
    n = F.char_length(line)
    return (n >= min_chars) & ((n >= MIN_CHARS) | line.rlike(r"\S"))


def lines_of(docs: DataFrame, min_chars: int = ALL_LINES) -> DataFrame:
    """(doc_id, at, line) of lines with ``min_chars`` code points or more; ``at`` counts from 0.

    Blank lines of fewer than `MIN_CHARS` never take part.
    """
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return cut.where(_takes_part(F.col("line"), min_chars))


#: Letters whose counts are compared first: an edit changes two counts by one at most.
LETTERS = "aeinrtoshlud"
#: Lines of one index entry that are compared with all their lookers-up; of a longer entry, lines that
#: the earliest one settles go, and the others meet again in finer cuts.
HOT = 64


def _letter_counts(line: Column) -> Column:
    """The counts of `LETTERS`, modulo 16, in one number."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)).cast("long"), 4 * i))
    return out


def _letters_apart(a: Column, b: Column) -> Column:
    total, four = F.lit(0), F.lit(15).cast("long")
    for i in range(len(LETTERS)):
        d = (F.shiftright(a, 4 * i).bitwiseAND(four) - F.shiftright(b, 4 * i).bitwiseAND(four)).bitwiseAND(four).cast("int")
        total = total + F.least(d, F.lit(16) - d)
    return total


def _cuts(parts: int, threshold: int) -> list[dict]:
    """What two lines within the threshold can share: ways to leave ``threshold`` of the ``parts`` segments out.

    The others are pieces (k, m, s): segments k to m - 1 of the shorter line, found s places further in the
    longer one, which has d code points more. With no more edits than segments left out, some way has
    all edits in them and as many in each run of them, at most, as it has segments: so much can the shift
    change there. ``own``: no shifts, as a line is entered into the index.
    """
    found, width = [], max(sum(b > a + 1 for a, b in pairwise([-1, *out, parts])) for out in combinations(range(parts), threshold))
    for way, out in enumerate(combinations(range(parts), threshold)):
        runs = [list(g) for _, g in groupby(out, key=lambda k, o=out: k - o.index(k))]
        for moves in product(*(range(-len(r), len(r) + 1) for r in runs)):
            if 0 <= (d := sum(moves)) <= threshold:
                starts, shifts = [0, *(r[-1] + 1 for r in runs)], [0, *accumulate(moves)]
                pieces = [(k, m, s) for k, m, s in zip(starts, [*(r[0] for r in runs), parts], shifts, strict=True) if m > k]
                cut = {"way": way, "d": d, "own": not d and not any(s for _, _, s in pieces)}
                for i, piece in enumerate(pieces + [(0, 0, 0)] * (width - len(pieces))):
                    cut |= {f"{x}{i}": v for x, v in zip("kms", piece, strict=True)}
                found.append(cut)
    return found


def entries(lines: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(id, letters, own, key) of lines (id, line, n, letters): under its own pieces (``own``, the index)
    and those that a partner of equal or less length can have in it.

    A place outside of the line gives some other text; what then meets is verified like all else.
    """
    cuts = _cuts(parts, threshold)
    kind = ", ".join(f"{x}: {'boolean' if x == 'own' else 'int'}" for x in cuts[0])
    each = lines.select("id", "letters", "n", "line", F.inline(F.from_json(F.lit(json.dumps(cuts)), f"array<struct<{kind}>>")))
    length = F.col("n") - F.col("d")
    at = lambda k: F.floor(length * F.col(k) / parts).cast("int")  # noqa: E731  where a segment starts in the shorter line
    pieces = [F.col("line").substr(at(f"k{i}") + F.col(f"s{i}") + 1, at(f"m{i}") - at(f"k{i}")) for i in range(len([x for x in cuts[0] if x[0] == "k"]))]
    return each.select("id", "letters", "own", F.xxhash64(F.lit(parts), length, "way", *pieces).alias("key"))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two lines where it is ``threshold`` or less, else something larger.

    Myers' vertical differences of the band of 2 * threshold + 1 cells around the diagonal, as bits of
    one number that shifts down the diagonal with each character of ``b``. Bit i of row j stands for
    place j - threshold + i of ``a``; places outside of ``a`` match nothing. The count kept is the
    distance at the lowest cell of the band; at the end it is followed up to the last place of ``a``.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    none = F.array_repeat(F.lit(None).cast("string"), threshold)
    zero = F.lit(0).cast("long")
    first = F.struct(F.lit((full << threshold) & full).cast("long").alias("vp"), zero.alias("vn"), F.lit(threshold).cast("long").alias("score"), F.lit(0).alias("j"))

    def step(chars: Column, state: Column, char: Column) -> Column:
        match = F.lit(0).cast("long")
        for i in range(width):
            match = match.bitwiseOR(F.when(F.get(chars, state["j"] + i) == char, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        mid = F.struct(match.alias("m"), state["vp"].alias("vp"), state["vn"].alias("vn"), state["score"].alias("score"), state["j"].alias("j"))
        return F.transform(F.array(mid), _advance)[0]

    def _advance(s: Column) -> Column:
        mask = F.lit(full).cast("long")
        d0 = (((s["m"].bitwiseAND(s["vp"])) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["m"]).bitwiseOR(s["vn"]).bitwiseAND(mask)
        return F.transform(F.array(F.struct(d0.alias("d0"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["score"].alias("score"), s["j"].alias("j"))), _finish)[0]

    def _finish(s: Column) -> Column:
        mask = F.lit(full).cast("long")
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(mask)
        hn = s["d0"].bitwiseAND(s["vp"])
        down = F.shiftright(s["d0"], 1)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["score"] + F.when(F.shiftright(s["d0"], width - 1).bitwiseAND(F.lit(1).cast("long")) == 1, 0).otherwise(1)).alias("score"),
            (s["j"] + 1).alias("j"),
        )

    # from the lowest cell of the last row (place len(b) + threshold) up to place len(a); the bits have moved on by one
    def last(s: Column) -> Column:
        up = F.char_length(b) + threshold - F.char_length(a)
        score = s["score"]
        for i in range(2 * threshold):
            bit = F.lit(1 << (width - 2 - i)).cast("long")
            change = F.when(s["vp"].bitwiseAND(bit) != 0, -1).when(s["vn"].bitwiseAND(bit) != 0, 1).otherwise(0)
            score = score + F.when(F.lit(i) < up, change).otherwise(0)
        return score

    # both lines are split once, not again for each character
    split = F.array(F.struct(F.concat(none, F.split(a, ""), none, none).alias("chars"), F.split(b, "").alias("other")))
    score = F.transform(split, lambda s: F.aggregate(s["other"], first, lambda state, char: step(s["chars"], state, char), last))[0]
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > threshold, F.lit(threshold + 1).cast("long")).otherwise(score)


def _common_front(a: Column, b: Column, step: int = 16) -> Column:
    """Leading characters that two lines share, in whole steps; one character at least is left of each."""
    k = F.floor((F.least(F.char_length(a), F.char_length(b)) - 1) / step).cast("int")
    differs = F.transform(F.sequence(F.lit(0), k - 1), lambda i: a.substr(i * step + 1, F.lit(step)) != b.substr(i * step + 1, F.lit(step)))
    first = F.array_position(differs, True).cast("int")
    return F.when(k < 1, 0).when(first == 0, k * step).otherwise((first - 1) * step).cast("int")


def _without_common_ends(both: DataFrame) -> DataFrame:
    """`la` and `lb` without what they share in front and behind, which no distance depends on; reversed."""
    for _ in range(2):
        both = both.withColumn("_k", _common_front(F.col("la"), F.col("lb")))
        both = both.withColumns({c: F.reverse(F.col(c).substr(F.col("_k") + 1, F.char_length(c))) for c in ("la", "lb")})
    return both.drop("_k")


def _linked(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(earlier, later): of the pairs (a, b) of line ids those within the threshold, by first occurrence."""
    a = lines.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("first").alias("fa"))
    b = lines.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("first").alias("fb"))
    both = pairs.distinct().join(a, "a").join(b, "b").withColumn("allowed", edits_allowed(F.least(F.char_length("la"), F.char_length("lb")), threshold))
    # pairs are few and short but dear: every task gets its share of them. They are written first, since
    # the filter would be pushed down and have its long expression filled with those that make its columns
    both = durable(_without_common_ends(both).repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    near = both.where(banded_distance(F.col("la"), F.col("lb"), threshold) <= F.col("allowed"))
    return near.select(F.when(F.col("fa") < F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("later"))


def _meeting(lines: DataFrame, parts: int, threshold: int) -> DataFrame:
    """The `entries` under keys where a line looks up another one, written: few of all."""
    made = entries(lines, parts, threshold)
    keys = durable(made.groupBy("key").agg(F.max("own").alias("own"), F.min("id").alias("a"), F.max("id").alias("b")).where("own and a <> b").select("key"))
    return durable(pick(made, keys, "key"))


def _meet(met: DataFrame, done: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs (a, b) of the lines under each key whose letters allow for the threshold, not both ``done``."""
    met = met.withColumn("done", F.lit(False)) if done is None else met.join(few(done.select("id", F.lit(True).alias("done"))), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    i, p = (met.where(which).select("key", F.col("id").alias(x), F.col("letters").alias(f"c{x}"), F.col("done").alias(f"d{x}")) for which, x in (("own", "a"), ("true", "b")))
    close = (F.col("a") != F.col("b")) & ~(F.col("da") & F.col("db")) & (_letters_apart(F.col("ca"), F.col("cb")) <= 2 * threshold)
    return i.join(p, (i["key"] == p["key"]) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_lines(lines: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(earlier, later): links between different lines, from (id, line, doc_id, at) and (id, first, times).

    Every line that is within `edits_allowed` of an earlier one is the later one of some link. Where an
    index entry holds more than `HOT` lines, all are compared with its earliest line; the pairs of which
    one line at least is not settled then meet again in a finer cut. Under the last cut all are compared.
    """
    # each line makes its entries where it stands; of lines that occur again one copy is gathered first
    again = few(durable(firsts.where("times > 1").select("id")))
    once = lines.select("id", "line").join(again, "id", "left_anti")
    copies = durable(lines.select("id", "line").join(again, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")))
    distinct = once.unionByName(copies).withColumns({"n": F.char_length("line"), "letters": _letter_counts(F.col("line"))})
    distinct = distinct.where(F.col("n") >= max(ONE_EDIT, threshold + 1))  # of shorter ones only equal ones count
    met = _meeting(distinct, threshold + 1, threshold)
    ids = durable(met.select("id").distinct())
    texts = durable(pick(distinct, ids, "id").join(pick(firsts, ids, "id").select("id", "first"), "id"))
    cuts, links, done = [threshold + 2, 2 * threshold + 2, 4 * threshold + 2], None, None
    while True:
        hot = durable(met.where("own").groupBy("key").count().where(F.col("count") > HOT).select("key"))
        if not cuts or hot.isEmpty():
            found = durable(_linked(_meet(met, done, threshold), texts, threshold))
            return found if links is None else links.union(found)
        crowd = durable(met.join(few(hot), "key", "left_semi"))
        centre = crowd.where("own").join(texts.select("id", "first"), "id").groupBy("key").agg(F.min_by(F.struct("id", "letters"), "first").alias("c"))
        star = centre.select("key", F.col("c.id").alias("a"), F.col("c.letters").alias("ca")).join(crowd.select("key", F.col("id").alias("b"), F.col("letters").alias("cb")), "key")
        star = star.where((F.col("a") != F.col("b")) & (_letters_apart(F.col("ca"), F.col("cb")) <= 2 * threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        usual = _meet(met.join(few(hot), "key", "left_anti"), done, threshold)
        found = durable(_linked(star.union(usual), texts, threshold))
        links = found if links is None else links.union(found)
        done = durable(links.select(F.col("later").alias("id")).distinct())
        inside = durable(crowd.select("id").distinct())
        met = _meeting(pick(texts, inside, "id"), cuts.pop(0), threshold)


def kept_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = ALL_LINES) -> DataFrame:
    """(doc_id, at): lines of ``min_chars`` or more that stay.

    The first occurrence of a line, by doc_id and place, stays unless the line is within `edits_allowed`
    (``threshold`` at most) of a line that occurs earlier; its other occurrences go. doc_id is taken as the key. Lines are
    told apart by a 64-bit hash.
    """
    lines = lines_of(docs, min_chars).withColumn("id", F.xxhash64("line"))
    firsts = durable(lines.groupBy("id").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times")))
    gone = durable(near_lines(lines, firsts, threshold).select(F.col("later").alias("id")).distinct())
    return firsts.join(gone, "id", "left_anti").select("first.doc_id", "first.at")


def _with_kept(docs: DataFrame, threshold: int, min_chars: int) -> tuple[DataFrame, str, str]:
    """The documents with how many lines each has and, in order, the lines that stay; the names of the two."""
    at, n, kept = free_name(docs, "_at"), free_name(docs, "_n_lines"), free_name(docs, "_kept")
    stay = kept_lines(docs, threshold, min_chars).groupBy("doc_id").agg(F.collect_list("at").alias(at))
    found = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left").drop(stay["doc_id"])
    # bound as variables, so that a text is split once
    own = F.array(F.struct(F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.coalesce(F.col(at), F.array().cast("array<int>")).alias("at")))

    def left(s: Column) -> Column:
        others = F.filter(F.transform(s["lines"], lambda x, i: F.when(~_takes_part(x, min_chars), i)), lambda i: i.isNotNull())
        places = F.filter(F.array_sort(F.array_distinct(F.concat(s["at"], others))), lambda i: i < F.size(s["lines"]))
        return F.struct(F.size(s["lines"]).cast("long").alias("n"), F.transform(places, lambda i: F.get(s["lines"], i)).alias("left"))

    return found.select(*docs.columns, F.inline(F.transform(own, left)).alias(n, kept)), n, kept


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = ALL_LINES) -> DataFrame:
    """doc_id, n_lines, n_kept and kept_sha256 (of the text that stays) of each document.

    Lines are split at \\n; those of fewer than ``min_chars`` code points always stay. A null text is
    one empty line. Rows that share a doc_id share the places that stay.
    """
    found, n, kept = _with_kept(docs.select("doc_id", "text"), threshold, min_chars)
    return found.select("doc_id", F.col(n).alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = ALL_LINES) -> DataFrame:
    """The documents without repeated lines. One of which nothing stays goes; n_chars follows the text.

    Null and blank texts stay as they are; rows that share a doc_id share the places that stay.
    """
    found, _, kept = _with_kept(docs, threshold, min_chars)
    text = free_name(found, "_text")
    out = found.withColumn(text, F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")))
    out = out.where((F.coalesce(F.trim(text), F.lit("")) != "") | (F.coalesce(F.trim("text"), F.lit("")) == ""))
    changed = {"text": F.col(text), "n_chars": F.when(F.col(text).eqNullSafe(F.col("text")), F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)).otherwise(F.char_length(text)).cast("long")}
    return out.select(*((changed[c].alias(c) if c in changed else F.col(c)) for c in docs.columns))
