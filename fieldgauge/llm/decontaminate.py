"""Benchmark passages in documents, found with an FM-index of each training shard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldgauge.llm.common import begin_task, durable, fields_without, free_name, set_aside
from fieldgauge.llm.fm_index import FMIndex

WINDOW = 10
#: Words of an index; a shard is as many neighbouring documents of one partition as fill it.
SHARD_WORDS = 1 << 18
#: Windows of the benchmark that are held by a task at once; more are searched in several blocks.
MAX_WINDOWS = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a to z after lower-casing A to Z, and characters from U+0080 on."""
    return (text or "").encode().translate(_LOWER).split()


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words joined by a space) of each window; a shorter item, if it has words, is one window."""
    kind = dict(benchmark.dtypes)["item_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                if w:
                    own = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}
                    found += own
                    ids += [item] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("item_id").type), pa.array(found, pa.binary())], names=["item_id", "window"])

    return benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(cut, f"item_id {kind}, window binary")


@dataclass(frozen=True)
class Phrases:
    """Windows as rows of word numbers, aligned at their ends, and the items of each."""

    number: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    starts: np.ndarray  # items[starts[p]:starts[p + 1]] belong to window p


def phrases(pairs: list[tuple[object, bytes]], window: int = WINDOW) -> Phrases:
    of: dict[bytes, list] = {}
    for item, w in pairs:
        of.setdefault(bytes(w), []).append(item)
    number: dict[bytes, int] = {}
    rows, lengths = np.zeros((len(of), window), np.int32), np.zeros(len(of), np.int64)
    for i, w in enumerate(of):
        ids = [number.setdefault(x, len(number) + 1) for x in w.split()]
        rows[i, window - len(ids) :] = ids
        lengths[i] = len(ids)
    items = np.empty(sum(map(len, of.values())), object)
    items[:] = [x for v in of.values() for x in v]
    return Phrases(number, rows, lengths, items, np.cumsum([0, *map(len, of.values())]))


def search_shard(ids: list[np.ndarray], p: Phrases, block: int | None = None) -> tuple[list[np.ndarray], list[set]]:
    """For each document of a shard its hit words and the windows that occur in it.

    The documents stand one after another with separators between. Words that no window has are
    separators too, a run of them one, since no occurrence can cross them. A shard of more words
    than an index holds (one very long document) is indexed in blocks that overlap by a window.
    """
    block = block or SHARD_WORDS
    all_ids = np.concatenate([np.append(x, 0) for x in ids]).astype(np.int64)
    begin = np.cumsum([0, *(len(x) + 1 for x in ids)])
    hit = np.zeros(len(all_ids) + 1, np.int32)
    found: list[set] = [set() for _ in ids]
    overlap = int(p.lengths.max(initial=1)) - 1
    for at in range(0, len(all_ids), block):
        part = np.append(all_ids[at : at + block + overlap], 0)
        keep = part > 0
        keep[1:] |= part[:-1] > 0  # of a run of separators the first
        if not (part > 0).any():
            continue
        place = np.flatnonzero(keep)
        index = FMIndex(part[keep], len(p.number))
        which, low, high = index.search(p.rows, p.lengths)
        count = high - low
        if not count.sum():
            continue
        which = np.repeat(which, count)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        start = at + place[index.locate(rows)]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + p.lengths[which], -1)
        doc = np.searchsorted(begin, start, "right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            found[d].add(w)
    inside = np.cumsum(hit) > 0
    return [inside[b : b + len(x)] for b, x in zip(begin, ids, strict=False)], found


def spans_of(hit: np.ndarray) -> np.ndarray:
    """(first word, word after the last) of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Adds ``n_words long``, ``spans array<struct<first,after>>`` (merged, in words) and ``items array``.

    Documents are not shuffled: the rows of a partition fill shards, and each shard is indexed and
    searched where it lies. The windows of the benchmark are sent to all tasks, ``max_windows`` or so
    at a time; a larger benchmark is searched in as many blocks, whose spans are then merged for each
    row. Null texts have no words; repeated rows get equal results; items without an id do not count.
    """
    return _found(docs, benchmark, text_col, window, max_windows, cut=False)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, max_windows: int, cut: bool) -> DataFrame:
    """As `find_passages`; with ``cut`` the texts (and n_chars) of one block are cut in the same pass."""
    named = windows(benchmark, window).withColumn("block", F.lit(0))
    total = named.count()
    blocks = max(1, -(-total // max_windows))
    if blocks > 1:
        named = named.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
    kind = dict(benchmark.dtypes)["item_id"]
    if blocks == 1:
        return _search(docs, phrases([(r.item_id, r.window) for r in named.collect()], window), text_col, kind, cut)
    row = free_name(docs, "_row")
    docs = durable(docs.withColumn(row, F.monotonically_increasing_id()))  # written: each block must see the same numbers
    parts = []
    for b in range(blocks):
        p = phrases([(r.item_id, r.window) for r in named.where(F.col("block") == b).collect()], window)
        parts.append(_search(docs.select(row, text_col), p, text_col, kind).drop(text_col))
    each = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of several blocks are merged: a span begins a new one where all before it have ended
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<first:bigint,after:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["after"] >= s["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["after"], s["after"]).alias("after")))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    found = docs.join(each.withColumn("spans", merged), row).drop(row)
    return found.mapInArrow(lambda batches: (_cut(b, text_col, b.column("spans").to_pylist()) for b in batches), found.schema) if cut else found


def _cut(batch: pa.RecordBatch, text_col: str, spans: list[list[dict]]) -> pa.RecordBatch:
    """The rows with the words of the spans cut out of their texts; ``n_chars`` follows where the frame has it."""
    if not any(spans):
        return batch
    names = batch.schema.names
    texts = batch.column(text_col).to_pylist()
    sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else []
    for i, own in enumerate(spans):
        if own:
            texts[i] = without_words(texts[i], [(x["first"], x["after"]) for x in own])
            if sizes:
                sizes[i] = len(texts[i])
    made = {c: pa.array(v, batch.schema.field(c).type) for c, v in ((text_col, texts), ("n_chars", sizes)) if v}
    return pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)


def _search(docs: DataFrame, p: Phrases, text_col: str, kind: str, cut: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(p)
    made = {"n_words", "spans", "items"}
    keep = fields_without(docs, made)
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T._parse_datatype_string(f"array<{kind}>"))])
    item_type = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        p = shared.value
        number = p.number

        def flush(kept: list[pa.RecordBatch], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            hits, found = search_shard(ids, p)
            at = 0
            for b in kept:
                n = b.num_rows
                spans = [[{"first": x, "after": y} for x, y in spans_of(h).tolist()] for h in hits[at : at + n]]
                b = _cut(b, text_col, spans) if cut else b
                items = [sorted({x for w in f for x in p.items[p.starts[w] : p.starts[w + 1]]}) for f in found[at : at + n]]
                sizes = pa.array([len(x) for x in ids[at : at + n]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), sizes, pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(items, pa.list_(item_type))], names=schema.names)
                at += n

        kept, ids, total = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for text in batch.column(text_col).to_pylist():
                w = words(text)
                ids.append(np.fromiter(map(number.get, w, repeat(0)), np.int32, len(w)))
                total += len(w) + 1
            kept.append(batch)
            if total >= SHARD_WORDS:
                yield from flush(kept, ids)
                kept, ids, total = [], [], 0
        if kept:
            yield from flush(kept, ids)

    return docs.mapInArrow(run, schema)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without their benchmark passages; one with nothing else in it goes.

    Documents without a passage stay as they are, null and empty texts too; repeated rows are cut alike.
    ``n_chars`` follows the text where the frame has it. Columns of the names that the search makes stay.
    """
    own = set_aside(docs, ("n_words", "spans", "items"))
    found = _found(docs.withColumnsRenamed(own), benchmark, "text", WINDOW, MAX_WINDOWS, cut=True)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])
    left = found.where((F.size("spans") == 0) | (total < F.col("n_words"))).drop("n_words", "spans", "items")
    return left.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) q),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ns WHERE len(w) >= n) q),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m) q) q GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
