"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a document for near-duplicate work: letters, digits and underscore.
WORD = r"\w+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may leave that unset: it gets a temporary folder. On a cluster each executor
    would write to its own disk there, so that is refused.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read again: the lineage ends there.

    Unlike a checkpoint's, the plan of the result knows the true size of the table, so sizes that
    are estimated from joins do not multiply over the rounds of a loop.
    """
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: What empties the stores that operators keep in a Python worker from task to task.
KEPT_IN_WORKER: list[Callable[[], None]] = []


def begin_task(keeps: bool = False) -> None:
    """Called where a task begins in a Python worker, which may have served other operators: what they kept goes, unless the
    operator is the one that ``keeps``, and memory that is free goes back to the system."""
    for clear in () if keeps else KEPT_IN_WORKER:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has that
    if trim is not None:
        trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the frame already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def fields_without(df: DataFrame, made: Iterable[str]) -> list:
    """The fields of the frame but those that have a name of ``made``, in letters of any case: Spark tells names apart without it."""
    taken = {m.lower() for m in made}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def set_aside(df: DataFrame, made: Iterable[str]) -> dict[str, str]:
    """Free names for the columns of the frame that have a name of ``made``, in letters of any case."""
    taken = {m.lower() for m in made}
    return {c: free_name(df, f"_own_{c}") for c in df.columns if c.lower() in taken}


#: Ids that are sent to all tasks to pick rows out of a table; beyond that the tables are joined.
BROADCAST_IDS = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows: marked for broadcast while it has few rows, else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def pick(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids``: by broadcast while these are few, else by a join."""
    return df.join(few(ids), key, "left_semi")


def hash_of_id(key: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 40))


def least_hashed(labels: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` rows of the least hash of their id, fewer where there are fewer; ids are distinct.

    What is ranked is small in every task: rows above a threshold that leaves some more than ``most`` go first.
    """
    n = labels.count()
    few_ = labels if n <= most else labels.where(hash_of_id(key) < int((1 << 40) * min(1.0, (1.2 * most + 200) / n)))
    return few_.orderBy(hash_of_id(key), key).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Of the ids that a document and a label have, ``most`` with their labels, written; the same ones each time.

    ``labels`` has one row for each id. Labels without a document, however many, take no place, nor do
    rows that repeat an id.
    """
    both = durable(docs.select(key).where(F.col(key).isNotNull()).distinct().join(labels, key))
    return durable(least_hashed(both, most, key))


def crc32_sql(blob: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a blob; needs `CRC32_TABLE` among its common tables and a cross join with it."""
    byte = "lambda x: CAST('0x' || x AS BIGINT)"
    bytes_ = f"list_transform(regexp_extract_all(hex({blob}), '..'), {byte})"
    step = "lambda c, b: xor(c >> 8, crc.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), {step}), 4294967295)"


#: ``crc``: one row with the 256 remainders of single bytes.
CRC32_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""
