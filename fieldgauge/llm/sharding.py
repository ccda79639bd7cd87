"""A reproducible shuffle into shards by a keyed permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import durable, fields_without, free_name, text_or_empty
from fieldgauge.llm.feistel import permute, round_keys

_IN_PARTITION = (1 << 33) - 1  # bits of monotonically_increasing_id() that count within a partition


def numbered(df: DataFrame, order: list[str], out_col: str = "row_number") -> tuple[DataFrame, int]:
    """The frame with gapless row numbers from 0 in the order of the columns, and the number of rows.

    The rows are dealt out by ranges of the columns and sorted there. What tells tied rows apart is
    their place in the input, so that a key with very many rows fills several ranges. The driver
    sees one count for each partition.
    """
    tie, local = free_name(df, "_tie"), free_name(df, "_local")
    ranged = df.withColumn(tie, F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie)
    kept = durable(ranged.drop(tie).withColumn(local, F.monotonically_increasing_id()))
    counts = kept.groupBy(F.shiftright(local, 33).alias("p")).count().collect()
    sizes = np.zeros(max([0, *(r["p"] + 1 for r in counts)]), np.int64)
    for r in counts:
        sizes[r["p"]] = r["count"]
    starts = df.sparkSession.sparkContext.broadcast(np.cumsum(sizes) - sizes)
    own = fields_without(kept, (local, out_col))
    schema = T.StructType([*own, T.StructField(out_col, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(local).to_numpy()
            rows = starts.value[at >> 33] + (at & _IN_PARTITION)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(rows)], names=schema.names)

    return kept.mapInArrow(number, schema), int(sizes.sum())


def shuffle_into_shards(df: DataFrame, order: list[str], shards: int, key: str) -> DataFrame:
    """Adds ``row_number``, ``shard int`` and ``slot long``: law `rows`, shard sizes at most one apart.

    Columns of the frame that have these names, in letters of any case, are replaced.

    Row number r goes to place p, p = permute(r); its shard is p modulo ``shards`` and its slot is
    p divided by it, so both follow from r, the number of rows and the key, and
    `row_of` leads back. Nulls of the order columns come first. Rows that tie in all order columns
    get neighbouring row numbers in the order of the input. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows, n = numbered(df, order)
    keys = round_keys(key)
    own = fields_without(rows, ("shard", "slot"))
    schema = T.StructType([*own, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(), n, keys)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=schema.names)

    return rows.mapInArrow(place, schema)


def row_of(shard: int, slot: int, n: int, shards: int, key: str) -> int:
    """The row number that is in this slot of this shard."""
    return int(permute(np.array([slot * shards + shard]), n, round_keys(key), back=True)[0])


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "shuffle") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of each document.

    Only the id, the size and the checksum are shuffled, never the text. The order is that of
    doc_id, checksum and size; a null text counts as empty (size 1, checksum 0).
    """
    slim = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(slim, ["doc_id", "text_crc32", "size"], shards, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
