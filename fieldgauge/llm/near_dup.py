"""Near-duplicate classes by Order MinHash and banded alignment.

Similarity of two documents: let a be the length of the longest common subsequence of their
sequences of five-word shingles; then a / (n1 + n2 - a). Without moved passages this is the Jaccard
similarity of the shingles. Two documents are linked at 0.8 or more.

Candidates come from buckets of Order MinHash sketches; texts of few shingles come from a prefix filter,
which loses none. Every text of a bucket is compared with the one that is in most buckets. A bucket in which
up to `SMALL` texts are then outside of its largest class gives the pairs of these with all others. A
larger one is a star around a member c of that class, and pairs are sought among the differences from c: let
x differ from c in the set X of shingles (those that one of the two lacks), d(x) of them shingles that x
lacks. Then x and y have |c| - d(x) - d(y) + |X n Y| shingles in common, and a link needs 4/9 (|x| + |y|). If
x shares too few shingles with c for a link, that asks for more than 5/9 d(y) + 4/9 (|Y| - d(y)) common
differences, and always for one. So a link of x has a common difference among so many of the rarest of X and
of Y, and those that very many texts of a star have, since c is the odd one out, come last. No bucket is
expanded into all its pairs, and no link that would join two classes is lost. A text with enough shingles of
c, but in another order, is compared with each other text of the star that has enough of them and is of
another class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.llm.common import begin_task, BROADCAST_IDS, durable, few, WORD
from fieldgauge.llm.hashed_terms import Cached

SHINGLE, SIMILARITY = 5, 0.8
#: Of the shingles of two texts together, those that a link needs in common.
SHARE = SIMILARITY / (1 + SIMILARITY)
#: Sketches of a text, and minima in each. Two texts of similarity 0.8 miss each other in all with
#: probability (1 - 0.8**5)**30, seven in a million, if they are long; 12 in a million from `FEW` shingles.
SKETCHES, MINIMA = 30, 5
#: Pairs of which one text has so many shingles at most are found without fail, by a prefix filter.
FEW = 64
#: Texts outside of the largest class of a bucket that are compared with all its others, in any round.
SMALL = 12
_FIND = re.compile(WORD)
_SEEDS = np.array([int.from_bytes(hashlib.sha256(f"sketch {i}".encode()).digest()[:8], "big") for i in range(SKETCHES)], np.uint64)
_BLOCK = 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit names of the five-word shingles, in order; fewer words make one shingle, none makes none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = words.astype(np.uint64) + np.uint64(1)
    k = min(SHINGLE, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x100000001B3) + w[i : n - k + 1 + i])
    return out


def _labelled(names: np.ndarray) -> np.ndarray:
    """Names of the shingles in which a repeated one has another name each time."""
    n = len(names)
    if not n:
        return names
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    labels = np.empty(n, np.uint64)
    at = np.arange(n)
    labels[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(names + labels * np.uint64(0xD6E8FEB86659FD93))


def prefix_size(n: int) -> int:
    """Of so many labelled shingles, in any one order, a text of similarity 0.8 has one among its own.

    A link needs 0.8 times the shingles of the longer text in common, so all but that many and one more.
    """
    return n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1


def sketch(names: np.ndarray) -> np.ndarray:
    """Order MinHash: for each seed the occurrence-labelled shingles of the least hashes, in text order."""
    n = len(names)
    if not n:
        return np.empty(0, np.int64)
    labelled = _labelled(names)
    values, places = [], []
    for a in range(0, n, _BLOCK):
        h = _mix(labelled[None, a : a + _BLOCK] ^ _SEEDS[:, None])
        for _ in range(min(MINIMA, h.shape[1])):
            least = h.argmin(1)
            values.append(h[np.arange(SKETCHES), least])
            places.append(a + least)
            h[np.arange(SKETCHES), least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    values, places = np.stack(values, 1), np.stack(places, 1)
    if values.shape[1] > MINIMA:
        best = np.argsort(values, 1, kind="stable")[:, :MINIMA]
        places = np.take_along_axis(places, best, 1)
    out = _SEEDS.copy()
    for column in np.sort(places, 1).T:
        out = _mix(out * np.uint64(0x100000001B3) + labelled[column])
    return out.astype(np.int64)


def aligned(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence over alignments that stay within the band.

    Bit-parallel by rows: bit j of the row says that column j adds nothing to the column before it.
    Only the columns of the band are held; what left it keeps its value.
    """
    same = int(np.argmin(np.append(x[: min(len(x), len(y))] == y[: min(len(x), len(y))], False)))
    x, y = x[same:], y[same:]
    m = min(len(x), len(y))
    tail = int(np.argmin(np.append(x[::-1][:m] == y[::-1][:m], False)))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    total = same + tail
    if not len(x) or not len(y):
        return total
    places: dict[int, int] = {}
    for j, name in enumerate(y.tolist()):
        places[name] = places.get(name, 0) | 1 << j
    low = 0
    high = min(len(y), band + 1)
    row = (1 << high) - 1  # ones: nothing matched yet
    for i, name in enumerate(x.tolist()):
        start, end = max(0, i - band), min(len(y), i + band + 1)
        if start >= len(y):
            break
        if start > low:
            out = start - low
            total += out - (row & ((1 << out) - 1)).bit_count()
            row >>= out
            low = start
        if end > high:
            row |= ((1 << (end - high)) - 1) << (high - low)
            high = end
        match = (places.get(name, 0) >> low) & ((1 << (high - low)) - 1)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & ((1 << (high - low)) - 1)
    return total + (high - low) - row.bit_count()


def compare(x: np.ndarray, y: np.ndarray) -> tuple[int, int, np.ndarray]:
    """State (0 linked, 1 too few common shingles, 2 enough of them but in another order), how many
    shingles of x are not in y, and all that one of the two lacks (labelled by occurrence)."""
    a, b = _labelled(x), _labelled(y)
    apart = np.setxor1d(a, b, assume_unique=True)
    common = (len(a) + len(b) - len(apart)) // 2
    need = SHARE * (len(x) + len(y)) - 1e-9
    state = 1 if common < need else 2 if aligned(x, y, int(len(x) + len(y) - 2 * need) + 1) < need else 0
    return state, len(a) - common, apart


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (64-bit digest of the words), n (shingles), words (32-bit hashes) of each row, keys
    (its sketches, if it has more than `FEW` shingles), and names and first (its labelled shingles and the
    size of its prefix, if a text of `FEW` or fewer can be similar to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        of = Cached(lambda w: crc32(w.encode("utf-8", "surrogatepass")))
        none = np.empty(0, np.int64)
        for batch in batches:
            nodes, sizes, kept, keys, short, first = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = _FIND.findall((text or "").lower())
                words = np.fromiter(map(of.__getitem__, found), np.uint32, len(found))
                names = shingles(words)
                n = len(names)
                nodes.append(hashlib.blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=8).digest())
                sizes.append(n)
                kept.append(words.tobytes())
                keys.append(sketch(names) if n > FEW else none)
                short.append(_labelled(names).astype(np.int64) if 0 < n * SIMILARITY <= FEW else none)
                first.append(prefix_size(n) if len(short[-1]) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.frombuffer(b"".join(nodes), "<i8")), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), _lists(keys), _lists(short), pa.array(first, pa.int64())],
                names=["doc_id", "node", "n", "words", "keys", "names", "first"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n long, words binary, keys array<long>, names array<long>, first long")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _ranked(rows: DataFrame, group: list[str], owner: str, useful: Column | None = None) -> DataFrame:
    """Rows (group, owner, s, total, ...) whose s is not its owner's alone, with its ``rank`` among those of the
    owner, the rarest within the group first. Those that nobody else has come before all, and so do those for
    which ``useful``, an aggregate, is false: they are only counted."""
    seen = rows.groupBy(*group, "s").agg(F.count("*").alias("texts"), (F.lit(True) if useful is None else useful).alias("useful")).where("texts > 1 and useful").drop("useful")
    each = Window.partitionBy(*group, owner)
    shared = rows.join(seen, [*group, "s"]).withColumn("shared", F.count("*").over(each))
    return shared.withColumn("rank", F.col("total") - F.col("shared") + F.row_number().over(each.orderBy("texts", "s")))


def _first_buckets(sig: DataFrame) -> DataFrame:
    """(key, node, n): texts under their sketches, short ones under the rarest of their shingles."""
    texts = sig.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "keys", "names", "first")))
    short = durable(texts.where("first > 0").select("node", "n", "first", F.explode("names").alias("s")))
    keys = _ranked(short.withColumn("total", F.col("n")), [], "node").where("rank <= first").select(F.xxhash64(F.lit("prefix"), "s").alias("key"), "node", "n")
    return texts.select(F.explode("keys").alias("key"), "node", "n").unionByName(keys)


def _sized(buckets: DataFrame) -> DataFrame:
    """(key, node, n, keys), written: buckets of more than one text; ``keys`` counts those of a text.

    Large ones that lie around one text, the one with most keys, become one bucket, so that a family of
    copies has few stars; no bucket is left out.
    """
    rows = durable(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    rows = durable(rows.join(rows.groupBy("node").agg(F.count("*").alias("keys")), "node"))
    large = rows.where(F.col("size") > SMALL)
    middle = durable(large.groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most")))
    dealt = large.join(few(middle), "key").select(F.xxhash64("most.node").alias("key"), "node", "n", "keys").distinct()
    return durable(rows.where(F.col("size") <= SMALL).select("key", "node", "n", "keys").unionByName(dealt))


def _with_class(rows: DataFrame, labels: DataFrame | None, column: str, label: str) -> DataFrame:
    """With the class of the text in ``column``; a text without links is its own class."""
    if labels is None:
        return rows.withColumn(label, F.col(column))
    return rows.join(few(labels.select(F.col("node").alias(column), F.col("label").alias(label))), column, "left").withColumn(label, F.coalesce(label, column))


def _apart(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (c, d) of different classes."""
    return _with_class(_with_class(edges, labels, "c", "a"), labels, "d", "b").where("a <> b").select("c", "d")


def _compared(edges: DataFrame, sig: DataFrame, differences: bool = False) -> DataFrame:
    """(c, d, state), written: each pair compared; for ``differences`` also the shingles of both (nc and n), how
    many of c's are ``lost`` in d, and all that one of the two lacks."""
    edges = durable(edges.select("c", "d"))
    names = ["c", "d", "state", "nc", "n", "lost", "apart"] if differences else ["c", "d", "state"]
    schema = "c long, d long, state int" + ", nc long, n long, lost long, apart array<long>" * differences
    pairs = edges.count()
    if not pairs:
        return sig.sparkSession.createDataFrame([], schema)
    ids = edges.select(F.col("c").alias("node")).union(edges.select("d")).distinct()
    ids = F.broadcast(ids) if 2 * pairs <= BROADCAST_IDS else ids
    words = sig.select("node", "words").join(ids, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    both = edges.join(words.select(F.col("node").alias("c"), F.col("words").alias("cw")), "c").join(words.select(F.col("node").alias("d"), F.col("words").alias("dw")), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            found, apart = [], []
            last, x = None, None
            for c, d in zip(batch.column("cw").to_pylist(), batch.column("dw").to_pylist(), strict=True):
                if c != last:
                    last, x = c, shingles(np.frombuffer(c, np.uint32))
                y = shingles(np.frombuffer(d, np.uint32))
                state, lost, other = compare(x, y)
                found.append((state, len(x), len(y), lost))
                apart.append(other.astype(np.int64))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("d"), *([*columns, _lists(apart)] if differences else columns[:1])], names=names)

    return durable(both.select("c", "d", "cw", "dw").mapInArrow(run, schema))


def _joined(labels: DataFrame | None, done: DataFrame) -> DataFrame | None:
    """The classes after the links among ``done``: the classes before are the nodes that these links join."""
    links = done.where("state = 0").select("c", "d")
    links = durable(_with_class(_with_class(links, labels, "c", "a"), labels, "d", "b").where("a <> b").select(F.col("a").alias("c"), F.col("b").alias("d")).distinct())
    if links.isEmpty():
        return labels
    new = components(links)
    if labels is None:
        return new
    further = labels.join(few(new.select(F.col("node").alias("label"), F.col("label").alias("new"))), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return durable(further.unionByName(new.join(few(labels.select("node")), "node", "left_anti")))


def _largest(rows: DataFrame) -> DataFrame:
    """The rows (key, node, label, ...) with ``main``, the label of most texts of a bucket, and ``others``, the texts that have another."""
    each = rows.groupBy("key", "label").agg(F.count("*").alias("texts"))
    most = each.groupBy("key").agg(F.max(F.struct("texts", "label")).alias("m"), F.sum("texts").alias("all")).select("key", F.col("m.label").alias("main"), (F.col("all") - F.col("m.texts")).alias("others"))
    return rows.join(few(durable(most.where("others > 0"))), "key")


def _families(rows: DataFrame) -> DataFrame:
    """Buckets that have texts in common as one, so that every text is in one star only."""
    centre = rows.groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most")).select("key", F.col("most.node").alias("c"))
    family = components(rows.join(few(durable(centre)), "key").select("c", F.col("node").alias("d")))
    return rows.select("node", "n", "keys").distinct().join(few(family.select("node", F.col("label").alias("key"))), "node")


def _stars(rows: DataFrame, sig: DataFrame) -> DataFrame:
    """Open buckets as stars: (key, c, d, label, minor, state, nc, n, lost, apart), written, without the centres.

    The centre is a text of the largest class, the one in most buckets; ``minor`` texts are of another class.
    """
    centre = rows.where("label = main").groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most")).select("key", F.col("most.node").alias("c"))
    star = durable(rows.join(few(durable(centre)), "key").where("node <> c").select("key", "c", F.col("node").alias("d"), "label", (F.col("label") != F.col("main")).alias("minor")))
    return durable(star.join(_compared(star.select("c", "d").distinct(), sig, differences=True), ["c", "d"]))


def _star_edges(stars: DataFrame) -> DataFrame:
    """(c, d): pairs of different classes whose differences from their centre allow for a link; see the head of this module.

    Texts that share too few shingles with the centre ask: those outside of the largest class, and all of
    a star that has moved texts.
    """
    moved = durable(stars.groupBy("key").agg(F.max(F.col("minor") & (F.col("state") == 2)).alias("moved")))
    asks = (F.col("state") == 1) & (F.col("minor") | F.col("moved"))
    each = stars.join(few(moved), "key").select("key", "d", "label", "n", "nc", "lost", asks.alias("asks"), F.size("apart").alias("total"), F.explode("apart").alias("s"))
    # a shingle that no asking text has, or only texts of one class, is in no pair
    useful = F.max("asks") & (F.min("label") != F.max("label"))
    ranked = durable(_ranked(each, ["key"], "d", useful).drop("texts", "shared"))

    def within(size, common):  # ranks of which one at least belongs to so many common differences
        return F.col(f"rank{size}") <= F.col(f"total{size}") - F.ceil(common - 1e-9) + 1

    x, y = (ranked.select("key", "s", "nc", *(F.col(c).alias(f"{c}{i}") for c in ("d", "label", "n", "lost", "total", "rank", "asks"))) for i in "xy")
    x = x.where(F.col("asksx") & within("x", F.lit(SHARE) * (F.col("nx") + F.col("nc")) - F.col("nc") + F.col("lostx")))
    y = y.drop("nc").where(within("y", F.greatest(F.lit(1.0), F.lit(1 - SHARE) * F.col("losty") + F.lit(SHARE) * (F.col("totaly") - F.col("losty")))))
    common = F.lit(SHARE) * (F.col("nx") + F.col("ny")) - F.col("nc") + F.col("lostx") + F.col("losty")
    sizes = F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(SIMILARITY) - 1e-9
    met = (x["key"] == y["key"]) & (x["s"] == y["s"]) & (F.col("labelx") != F.col("labely")) & sizes & within("x", common) & within("y", common)
    return x.join(y, met).select(F.least("dx", "dy").alias("c"), F.greatest("dx", "dy").alias("d")).distinct()


def _moved_edges(stars: DataFrame) -> DataFrame:
    """(c, d): pairs of a star of which one is in another order than the centre.

    Such a text need share nothing outside of the centre with its partner, so it is compared with all
    members that are near enough in size and not known to share too few shingles with the centre (those
    ask themselves), save those of its class. Each pair is a row of its own.
    """
    near = stars.where("state <> 1").select("key", "d", "n", "state", "label")
    moved = durable(near.where("state = 2").select("key", F.col("d").alias("x"), F.col("n").alias("nx"), F.col("label").alias("of_x")))
    sizes = (F.least("n", "nx") >= F.greatest("n", "nx") * F.lit(SIMILARITY) - 1e-9) & (F.col("label") != F.col("of_x"))
    return near.join(few(moved), "key").where(sizes).select(F.least("d", "x").alias("c"), F.greatest("d", "x").alias("d")).distinct()


def classes(sig: DataFrame) -> DataFrame | None:
    """(node, label) of the nodes that have links: the class of each, named by its least node; None without links."""
    rows = _sized(durable(_first_buckets(sig)))
    centre = durable(rows.groupBy("key").agg(F.max(F.struct("keys", "node")).alias("most")).select("key", F.col("most.node").alias("c")))
    edges = durable(rows.join(few(centre), "key").where("node <> c").groupBy("c", F.col("node").alias("d")).agg(F.count("*").alias("keys")))
    best = edges.groupBy("d").agg(F.max(F.struct("keys", "c")).alias("most")).select(F.col("most.c").alias("c"), "d")
    labels = _joined(None, _compared(best, sig))
    labels = _joined(labels, _compared(_apart(edges, labels), sig))
    # buckets of more than one class: the few that are outside of the largest one meet all others
    open_ = durable(_largest(_with_class(rows, labels, "node", "label")))
    minor = open_.where((F.col("others") <= SMALL) & (F.col("label") != F.col("main"))).select("key", F.col("node").alias("x"), F.col("label").alias("of_x"))
    pairs = open_.where(F.col("others") <= SMALL).select("key", "node", "label").join(minor, "key").where("label <> of_x")
    labels = _joined(labels, _compared(pairs.select(F.least("node", "x").alias("c"), F.greatest("node", "x").alias("d")).distinct(), sig))
    wide = open_.where(F.col("others") > SMALL).select("key", "node", "n", "keys")
    if wide.isEmpty():
        return labels
    stars = _stars(durable(_largest(_with_class(_families(wide), labels, "node", "label"))), sig)
    return _joined(labels, _compared(_star_edges(stars).union(_moved_edges(stars)).distinct(), sig))


def components(links: DataFrame) -> DataFrame:
    """(node, label), written: the least node of each connected component, for nodes with links.

    Each round takes the least label among neighbours and then follows the label's own label, so
    the rounds grow with the logarithm of a component's width.
    """
    both = durable(links.select(F.col("c").alias("node"), F.col("d").alias("other")).union(links.select("d", "c")).distinct())
    labels = durable(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(few(labels.select(F.col("node").alias("other"), "label")), "other").groupBy("node").agg(F.min("label").alias("m"))
        own = labels.select("node", F.col("label").alias("old"))
        better = near.join(few(own), "node").select("node", F.least("old", "m").alias("label"), "old")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = durable(better.join(few(jump), "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = not new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of each document: the least doc_id of all that links connect it with.

    Words are runs of letters, digits and underscores in lower case. Documents with the same words are
    one class; that holds for documents without words too. A text of fewer than five words has one
    shingle. Null texts count as empty, repeated rows are kept, and a class of null ids has a null id.
    """
    sig = durable(signatures(docs))
    named = durable(_with_class(sig.select("doc_id", "node"), classes(sig), "node", "label").select("doc_id", "label"))
    least = durable(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")))
    # a text without others is its own class and need not be joined
    shared = few(durable(least.where("rows > 1").select("label", "class_id", F.lit(True).alias("_shared"))))
    return named.join(shared, "label", "left").select("doc_id", F.when(F.col("_shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the first of their class, with their own columns; doc_id is taken as the key."""
    classes = near_duplicate_classes(docs)
    gone = durable(classes.where("doc_id <> class_id").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
