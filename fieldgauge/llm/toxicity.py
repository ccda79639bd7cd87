"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import fields_without
from fieldgauge.llm.hashed_terms import Adam, Cached, dense, present, sample, select_slots, word_slots


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms that a text has."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str | None], of: Cached) -> np.ndarray:
        """Scores from 0 to 1 of whole texts; a text without known terms gets that of the bias."""
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found: set[int] = set()
            for s in map(of.__getitem__, set(_words(text))):
                found.update(s)
            if found:
                at = np.array(sorted(found))
                v = self.factors[at]
                out[i] += self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def known(self) -> Cached:
        """word -> the places of its terms among those that the machine has weights for."""
        place = {int(s): i for i, s in enumerate(self.slots)}
        return Cached(lambda w: tuple(place[s] for s in word_slots(w) if s in place))


def _words(text: str | None) -> list[str]:
    from fieldgauge.llm.hashed_terms import _WORD

    return _WORD.findall((text or "").lower())


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], most_terms: int = 2048, factors: int = 8, steps: int = 150, rate: float = 0.05, penalty: float = 2e-4, seed: int = 7) -> Machine:
    """Logistic loss with squared penalties, by full-batch Adam steps on the selected terms.

    Without rows, or with one label only, the machine has a bias alone.
    """
    y = np.array([r[0] for r in rows], np.float32)
    slots = select_slots(rows, most_terms)
    share = (y.sum() + 0.5) / (len(y) + 1)
    x = dense(rows, slots)
    bias, w = np.array([np.log(share / (1 - share))], np.float32), np.zeros(len(slots), np.float32)
    v = np.random.default_rng(seed).normal(0, 0.01, (len(slots), factors)).astype(np.float32)
    if len(slots):
        adam = Adam([bias, w, v], rate)
        for _ in range(steps):
            s = x @ v
            z = bias[0] + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))  # values are 0 or 1
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
            gx = g @ x
            adam.step([np.array([g.sum()], np.float32), gx + penalty * w, x.T @ (g[:, None] * s) - gx[:, None] * v + 5 * penalty * v])
    return Machine(slots, float(bias[0]), w.astype(float), v.astype(float))


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, most_terms: int = 2048) -> Machine:
    """Fit on at most ``max_rows`` labelled texts (`toxic` 0 or 1; the higher of several labels of an id).

    ``max_rows`` bounds what reaches the driver; the sample is that of the least hashes of the ids. The
    model has the ``most_terms`` terms most associated with the label.
    """
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))

    def featurize():
        of = Cached(word_slots)

        def make(text):
            s = present(text, of)
            return s, np.ones(len(s), np.float32)

        return make

    return fit(sample(docs, lab, max_rows, featurize), most_terms)


def score(df: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score of each whole text; null counts as empty. One pass, no shuffle. A column of its name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    keep = fields_without(df, [out_col])
    schema = T.StructType([*keep, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.known()
        for batch in batches:
            scores = shared.value.scores(batch.column(text_col).to_pylist(), of)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(scores)], names=schema.names)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: the checksum of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, threshold: float = 0.3, most_terms: int = 2048) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    Null counts as an empty text, which has the score of no terms; a null id is not held out. Repeated
    rows give repeated rows; without labels every score is one half.
    """
    machine = fit_on(docs.where(~held_out()), labels.where(~held_out()), max_rows, most_terms)
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
