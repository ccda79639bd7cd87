"""Merkle manifests of a dataset: a tree for each group of rows, and one over the groups' roots.

A node is the lower-case hex sha256 of what it covers; `FANOUT` consecutive nodes have their digests
joined as text and hashed to a parent, the last run of a level may be shorter. Rows are dealt into
aligned blocks of ``FANOUT ** LEVELS`` leaves. A block keeps each level as one string of hex digits, so
that parents and siblings are substrings of fixed width; its top node is a leaf of the next tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.llm.common import CRC32_TABLE, crc32_sql, durable, few, free_name

FANOUT = 8
#: Levels within a block: 512 leaves, whose level is a string of 32 kB.
LEVELS = 3
WIDTH = 64  # hex digits of a digest
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` if null, else its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered_in_groups(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Columns ``_at`` (gapless from 0 within the group) and ``_n`` (rows of the group); order nulls first.

    Rows are dealt out by ranges of group and order, so a group may fill many tasks. What is before a
    task's rows of a group follows from one count for each task and group: as many rows as there are
    tasks and groups together.
    """
    tie, local = free_name(df, "_tie"), free_name(df, "_local")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, tie]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kept = durable(ranged.drop(tie).withColumn(local, F.monotonically_increasing_id()))
    part = F.shiftright(local, 33).alias("_part")
    counts = kept.groupBy(part, F.col(group).alias("_group")).agg(F.min(local).alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = few(durable(counts.select("_part", "_group", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("_n"))))
    same = (F.shiftright(local, 33) == starts["_part"]) & kept[group].eqNullSafe(starts["_group"])
    return kept.join(starts, same).select(*df.columns, (F.col(local) - F.col("_first") + F.col("_before")).alias("_at"), "_n")


def _parents(level: Column) -> Column:
    """The digests of the runs of a level, joined."""
    run = FANOUT * WIDTH
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def _height(j: int) -> Column:
    """Whether level j of a tree of ``n`` leaves has a level above."""
    return F.col("n") > FANOUT**j


def _blocks(nodes: DataFrame) -> DataFrame:
    """g, b, n, bodies, levels l0 to l2 and top of each block of the nodes (g, at, n, hash, body)."""
    span = FANOUT**LEVELS
    rows = F.sort_array(F.collect_list(F.struct("at", "hash", "body")))
    made = nodes.groupBy("g", F.floor(F.col("at") / span).alias("b")).agg(F.max("n").alias("n"), rows.alias("rows"))
    made = made.select("g", "b", "n", F.col("rows.body").alias("bodies"), F.array_join("rows.hash", "").cast("binary").alias("l0"))
    for j in range(LEVELS):
        made = made.withColumn(f"l{j + 1}", F.when(_height(j), _parents(F.col(f"l{j}"))))
    top = F.coalesce(*(F.col(f"l{j}") for j in range(LEVELS, -1, -1))).cast("string")
    return durable(made.withColumn("top", top).drop(f"l{LEVELS}"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, of their tops, and so on, up to the tier where each group left is one block."""
    span = FANOUT**LEVELS
    tiers = [_blocks(nodes)]
    while (more := tiers[-1].where(F.col("n") > span)).take(1):
        tiers.append(_blocks(more.select("g", F.col("b").alias("at"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("hash"), F.lit(0).alias("body"))))
    return tiers


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """(g, top) of each group: of the tier where it is one block."""
    out = [t.where(F.col("n") <= FANOUT**LEVELS).select("g", "top") for t in tiers]
    for t in out[1:]:
        out[0] = out[0].unionByName(t)
    return out[0]


def _siblings(level: Column, at: Column) -> Column:
    """What stands in a level before and after node ``at`` within its run."""
    inside = at % FANOUT
    left = F.substring(level, (at - inside) * WIDTH + 1, inside * WIDTH)
    right = F.substring(level, (at + 1) * WIDTH + 1, (FANOUT - 1 - inside) * WIDTH)
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, at, hash, body, subroot, root, path) of the nodes of the first tier.

    ``above`` has (g, subroot, root, path) of each group. A block gets the path of its top node from the
    tier above it or, if it is all of its group, from ``above``: one row of that for each group, so no
    group meets it twice.
    """
    span, held = FANOUT**LEVELS, above.withColumn("b", F.lit(0).cast("long"))
    up = held
    for k in range(len(tiers) - 1, -1, -1):
        blocks = tiers[k].drop("top")
        up = up.select(F.col("g").alias("_g"), F.col("b").alias("_b"), "subroot", "root", F.col("path").alias("_up"))
        joined = blocks.join(up, blocks["g"].eqNullSafe(up["_g"]) & (blocks["b"] == up["_b"]))

        def node(body: Column, i: Column) -> Column:
            own = [F.when(_height(j), _siblings(F.col(f"l{j}"), F.floor(i / FANOUT**j).cast("int"))) for j in range(LEVELS)]
            return F.struct(i.alias("i"), F.substring(F.col("l0"), i * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("hash"), body.alias("body"), F.concat(F.array_compact(F.array(*own)), F.col("_up")).alias("path"))

        out = joined.select("g", "b", "subroot", "root", F.explode(F.transform("bodies", node)).alias("x"))
        up = out.select("g", (F.col("b") * span + F.col("x.i")).alias("b"), F.col("x.hash").alias("hash"), F.col("x.body").alias("body"), "subroot", "root", F.col("x.path").alias("path"))
        if k:  # groups that are one block of the tier below
            up = up.select(*above.columns, "b").unionByName(tiers[k - 1].where(F.col("n") <= span).select(F.col("g").alias("_own")).join(above, F.col("_own").eqNullSafe(above["g"])).select(*above.columns, F.lit(0).cast("long").alias("b")))
    return up


def prove(df: DataFrame, leaf: str, group: str, order: list[str]) -> DataFrame:
    """The rows with ``subroot``, ``root`` and ``path``: the siblings' digests from the leaf to the root.

    ``path`` is an array of (left, right), the digests of a run before and after the node, joined; see
    `folded`. Groups are ordered with null first and bytewise for strings, rows of a group by the
    columns of ``order``, nulls first, and then by the leaf, so rows that tie in these are equal leaves and any order
    of them gives the same tree. Columns that have a result's name, in letters of any case, are replaced. An
    empty table stays empty. Only leaves and the other columns are shuffled, two times; pass narrow rows.
    """
    made = ["subroot", "root", "path"]
    own = [c for c in df.columns if c.lower() not in made]
    packed = df.select(F.col(group).alias("g"), F.col(leaf).alias("hash"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*own).alias("body"))
    rows = numbered_in_groups(packed, "g", [*(f"o{i}" for i in range(len(order))), "hash"])
    tiers = _tiers(rows.select("g", F.col("_at").alias("at"), F.col("_n").alias("n"), "hash", "body"))
    subroots = _tops(tiers).withColumn("one", F.lit(0))
    roots = numbered_in_groups(subroots, "one", ["g"])
    top = _tiers(roots.select(F.col("one").alias("g"), F.col("_at").alias("at"), F.col("_n").alias("n"), F.col("top").alias("hash"), F.struct("g").alias("body")))
    root = _tops(top).select("g", F.lit("").alias("subroot"), F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    groups = durable(_down(top, root).select(F.col("body.g").alias("g"), F.col("hash").alias("subroot"), "root", "path"))
    return _down(tiers, groups).select("body.*", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    A third of the documents, by the checksum of the id, is verified with a text whose A-Z are
    lower-cased. Null ids come first and are never changed; repeated rows are leaves of their own.
    """
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", A_TO_Z, A_TO_Z.lower()))
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    slim = docs.select("doc_id", "lang", leaf(*rest, F.col("text")).alias("leaf"), F.when(text != F.col("text"), leaf(*rest, text)).alias("changed"))
    done = prove(slim, "leaf", "lang", ["doc_id"])
    done = done.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int = 9) -> str:
    """The trees level by level, one common table a level, for up to FANOUT ** depth rows of a group."""

    def tree(name: str, leaves: str) -> list[str]:
        out = [f"{name}0 AS ({leaves})"]
        for j in range(depth):
            out.append(f"{name}{j + 1} AS (SELECT g, pos // 8 AS pos, first((n + 7) // 8) AS n, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, list(hash ORDER BY pos) AS kids FROM {name}{j} WHERE n > 1 GROUP BY g, pos // 8)")
        return out

    def climb(name: str, start: str, on: str) -> list[str]:
        """at, node and siblings of each row, level by level; rows without a level above stay as they are."""
        out, last = [], start
        for j in range(1, depth + 1):
            i = "CAST(l.pos % 8 AS BIGINT)"
            out.append(f"{name}{j} AS (SELECT l.* REPLACE (l.pos // 8 AS pos, CASE WHEN k.kids IS NULL THEN l.node ELSE sha256(array_to_string(k.kids[:{i}], '') || l.node || array_to_string(k.kids[{i} + 2:], '')) END AS node, l.sibs || coalesce(array_to_string(k.kids[:{i}] || k.kids[{i} + 2:], ''), '') AS sibs) FROM {last} l LEFT JOIN {on}{j} k ON k.g IS NOT DISTINCT FROM l.g AND k.pos = l.pos // 8)")
            last = f"{name}{j}"
        return out

    def one(value: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def of(text: str) -> str:
        return "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    lower = f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"
    rows = f"r AS (SELECT doc_id, lang AS g, {of('text')} AS leaf, CASE WHEN c % 3 = 0 THEN {of(lower)} ELSE {of('text')} END AS shown FROM (SELECT *, {crc32_sql('encode(CAST(doc_id AS VARCHAR))')} AS c FROM documents CROSS JOIN crc) q)"
    placed = "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM r)"
    tops = " UNION ALL ".join(f"SELECT g, hash FROM a{j} WHERE n = 1" for j in range(depth + 1))
    over = "SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, hash FROM tops"
    root = " UNION ALL ".join(f"SELECT hash FROM b{j} WHERE n = 1" for j in range(depth + 1))
    tables = [CRC32_TABLE, rows, placed, *tree("a", "SELECT g, pos, n, leaf AS hash FROM p"), f"tops AS ({tops})", *tree("b", over), f"root AS ({root})"]
    tables += ["u0 AS (SELECT doc_id, leaf, g, pos, shown AS node, '' AS sibs FROM p)", *climb("u", "u0", "a")]
    tables += [f"v0 AS (SELECT u.doc_id, u.leaf, t.hash AS subroot, 0 AS g, t.pos, u.node, u.sibs FROM u{depth} u JOIN (SELECT g, hash, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM tops) t ON t.g IS NOT DISTINCT FROM u.g)", *climb("v", "v0", "b")]
    return f"WITH {', '.join(tables)} SELECT doc_id, leaf, subroot, root.hash AS root, sha256(sibs) AS proof_sha256, node AS folded_root, node = root.hash AS verified FROM v{depth} CROSS JOIN root"


ORACLE = _oracle()
