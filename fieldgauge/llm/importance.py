"""Importance resampling: documents drawn by how much their n-grams resemble those of a target corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import CRC32_TABLE, crc32_sql, durable, fields_without, free_name
from fieldgauge.llm.hashed_terms import Cached
from fieldgauge.llm.sharding import numbered

BUCKETS, RUN = 10_000, 1
#: A-Z are lower-cased before; bytes above 0x7F belong to characters that count as letters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands between the texts of a batch; it is no part of a word.
SENTINEL = b"\x00"
#: Bytes of texts that are joined at once; a longer text is joined with no other.
JOINED = 1 << 20


def slices(texts: list[bytes], most: int = JOINED) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts that have some ``most`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Runs:
    """Buckets of all runs of 1 to ``longest`` words of a batch of texts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = RUN):
        self.buckets, self.longest, self.sums = buckets, longest, Cached(crc32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text and the bucket of each run, and the words of each text.

        The texts are joined, one pass finds the words of all of them, and the offsets at which texts
        begin tell which text a word is in; runs that cross into the next text are masked.
        """
        joined = SENTINEL.join(texts).lower()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        at, words = [], []
        for m in WORD.finditer(joined):
            at.append(m.start())
            words.append(m.group())
        of = np.searchsorted(begins, np.array(at, np.int64), "right") - 1
        sums = list(map(self.sums.__getitem__, words))
        owners, found = [of], [np.array(sums, np.int64)]
        for n in range(2, self.longest + 1):
            sums = [crc32(b" " + w, c) for w, c in zip(words[n - 1 :], sums, strict=False)]
            inside = of[: len(sums)] == of[n - 1 :]
            owners.append(of[: len(sums)][inside])
            found.append(np.array(sums, np.int64)[inside])
        return np.concatenate(owners), np.concatenate(found) % self.buckets, np.bincount(of, minlength=len(texts))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("_text").to_pylist()]


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = RUN) -> np.ndarray:
    """How many runs of the whole table are in each bucket: one row a bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = Runs(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _texts(batch)
            for i, j in slices(texts):
                total += np.bincount(runs(texts[i:j])[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "runs"])

    made = df.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(count, "bucket long, runs long")
    out = np.zeros(buckets, np.int64)
    for r in made.groupBy("bucket").agg(F.sum("runs").alias("runs")).collect():  # as many rows as buckets at most
        out[r.bucket] = r.runs
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p_target / p_own)) of each bucket, with one run added to each."""
    n, all_own, all_target = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (all_own + n) / ((int(s) + 1) * (all_target + n)))) for s, t in zip(own, target, strict=True)], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, text_col: str = "text", longest: int = RUN) -> DataFrame:
    """The other columns and n_words, n_features and weight (the floored mean of the gains, 0 without features).

    Columns that have a result's name, in letters of any case, are replaced.
    """
    made = ["n_words", "n_features", "weight"]
    keep = fields_without(df, [*made, text_col])
    packed = df.select(F.struct(*(f.name for f in keep)).alias("own"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([packed.schema["own"], *(T.StructField(c, T.LongType()) for c in made)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(len(gain), longest)
        for batch in batches:
            texts, rows = _texts(batch), [np.empty((0, 3), np.int64)]
            for i, j in slices(texts):
                of, bucket, words = runs(texts[i:j])
                n = np.bincount(of, minlength=j - i)
                total = np.bincount(of, weights=gain[bucket], minlength=j - i).astype(np.int64)  # whole numbers, exact below 2**53
                rows.append(np.column_stack([words, n, total // np.maximum(n, 1)]))
            table = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(table[:, c]) for c in range(3))], names=schema.names)

    return packed.mapInArrow(weigh, schema).select("own.*", *made)


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))), u in (0, 1) by the sha256 of seed and key; a null key counts as empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024", buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each document; undrawn ones have no rank.

    Of the documents with ``min_words`` words, ``percent`` of a hundred are drawn without replacement: those of the
    highest weight plus Gumbel noise, which is drawing in proportion to exp(weight / 1000). Ties go to the smaller
    doc_id, then to the earlier row; null ids come first. Null texts have no words. The text is read twice, once for
    the counts of its buckets and once for weights; ranks come from rows dealt out by ranges of the score.
    """
    if not (0 <= percent <= 100 and buckets > 0 and longest > 0):
        raise ValueError("a share of 0 to 100, buckets and a length of runs are needed")
    gain = gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, "text", buckets, longest))
    rows = weighed(docs.select("doc_id", "text"), gain, "text", longest)
    rows = durable(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    placed, n = numbered(rows.where(F.col("n_words") >= min_words).withColumn("_less", -F.col("score")), ["_less", "doc_id"], "rank")
    rank = F.when(F.col("rank") < n * percent // 100, F.col("rank") + 1).alias("rank")
    return placed.select(*rows.columns, rank).unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of the documents that are drawn; rows that share a doc_id are drawn together with one of them."""
    drawn = ranked(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    name = free_name(docs, "_drawn")
    return docs.join(drawn.withColumnRenamed("doc_id", name), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def importance(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH {CRC32_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) q GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) q GROUP BY ALL),
v AS (SELECT w, CAST({crc32_sql("encode(w)")} % 10000 AS BIGINT) AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw) q CROSS JOIN crc),
s AS (SELECT b, sum(n) AS s FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bw JOIN v USING (w) GROUP BY b),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
g AS (SELECT v.w, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM v LEFT JOIN s USING (b) LEFT JOIN t USING (b) CROSS JOIN a),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM dw JOIN g USING (w) GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_features, CAST(coalesce(m.weight, 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM y LEFT JOIN z USING (doc_id)
"""
