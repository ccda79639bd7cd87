"""Hashed terms of whole texts, and samples of them for fitting on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import begin_task, labelled_sample

SLOTS = 1 << 18
_WORD = re.compile(r"\w+")
_SHAPES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a")), (r"\d+", "9"), (r"([^\w])\1+", r"\1\1"))]


def slot(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) % SLOTS


class Cached(dict):
    """What a function of a word gives, kept for a bounded number of words."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        made = self.make(word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = made
        return made


def word_slots(word: str) -> tuple[int, ...]:
    """A word, and its first four and five letters where it is longer: stems with unknown endings."""
    out = [slot("w:" + word)]
    if len(word) > 4:
        out.append(slot("4:" + word[:4]))
    if len(word) > 5:
        out.append(slot("5:" + word[:5]))
    return tuple(out)


def present(text: str, of: Cached) -> np.ndarray:
    """The slots of the lower-case words of a text, each once, ascending."""
    found = set()
    for s in map(of.__getitem__, set(_WORD.findall(text.lower()))):
        found.update(s)
    return np.array(sorted(found), np.int32)


def shape(token: str) -> str:
    """The outline of a token: case of its letters, digits, and signs; repeats show twice."""
    for pattern, put in _SHAPES:
        token = pattern.sub(put, token)
    return token[:12]


def token_slots(token: str) -> tuple[int, int]:
    return slot("s:" + shape(token)), slot("w:" + token.lower())


_AGAIN = [slot(f"r:{k}") for k in range(3)]


def shares(text: str, of: Cached) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: the root of the share of its tokens that have the term.

    Terms are tokens, their shapes, and three marks of repetition: a token that equals the one
    before it, that occurs before in its text, and that occurs before in its line.
    """
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    flat = np.array(list(map(of.__getitem__, tokens)), np.int64).ravel()
    ids, counts = np.unique(flat, return_counts=True)
    first: dict[str, int] = {}
    at = np.fromiter(map(first.setdefault, tokens, range(n)), np.int64, n)
    marks = [int((at[1:] == at[:-1]).sum()), n - len(first), sum(len(w) - len(set(w)) for w in (x.split() for x in text.split("\n")))]
    ids = np.concatenate([ids, _AGAIN])
    counts = np.concatenate([counts, marks])
    return ids.astype(np.int32), np.sqrt(counts / n).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, featurize) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, slots, values) of at most ``max_rows`` labelled texts, the same ones each time.

    ``labels`` has one `_y` for each doc_id. Of the ids that documents have, those of the least hash are taken, so the
    bound holds whatever the tables hold; whole texts are turned into slots on the executors. Of rows that
    share an id the text of the least hash is used, of equal texts with equal labels one.
    """
    # the ids are taken first, so that no text is sorted
    ids = labelled_sample(docs, labels, max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = texts.groupBy("doc_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        make = featurize()
        for batch in batches:
            made = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([b.tobytes() for _, b in made], pa.binary())], names=["h", "y", "slots", "vals"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("slots", T.BinaryType()), T.StructField("vals", T.BinaryType())])
    rows = chosen.select(F.xxhash64("text").alias("_h"), F.col("_y").cast("int"), "text").mapInArrow(run, schema).collect()
    seen = {(r.h, r.y): r for r in rows}
    return [(r.y, np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32)) for _, r in sorted(seen.items())]


def select_slots(rows: list[tuple[int, np.ndarray, np.ndarray]], most: int, least_rows: int = 4) -> np.ndarray:
    """The slots most associated with either side of some threshold between labels, by the log-likelihood ratio."""
    y = np.array([r[0] for r in rows])
    best_of = np.zeros(SLOTS)

    def count(chosen):
        return np.bincount(np.concatenate([s for (_, s, _), k in zip(rows, chosen, strict=True) if k]), minlength=SLOTS).astype(float)

    def part(seen, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0)

    for top in np.unique(y)[:-1]:
        low = y <= top
        n1, n0 = int(low.sum()), int((~low).sum())
        a, b = count(low), count(~low)
        t, n = a + b, n0 + n1
        g = part(a, t * n1 / n) + part(b, t * n0 / n) + part(n1 - a, (n - t) * n1 / n) + part(n0 - b, (n - t) * n0 / n)
        best_of = np.maximum(best_of, np.where(t < least_rows, 0, g))
    best = np.argsort(-best_of, kind="stable")[:most]
    return np.sort(best[best_of[best] > 3])


def dense(rows: list[tuple[int, np.ndarray, np.ndarray]], slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(slots)), np.float32)
    for i, (_, s, v) in enumerate(rows):
        at = np.searchsorted(slots, s)
        ok = at < len(slots)
        ok[ok] = slots[at[ok]] == s[ok]
        out[i, at[ok]] = v[ok]
    return out


class Adam:
    """Steps for a list of arrays."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
