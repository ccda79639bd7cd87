"""A quality classifier by ordinal regression: one weight vector, ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import begin_task, fields_without, set_aside
from fieldgauge.llm.hashed_terms import _AGAIN, Adam, Cached, dense, sample, select_slots, shares, token_slots


@dataclass(frozen=True)
class Ordinal:
    """P(grade >= k) = sigmoid(w.x - threshold_k); the thresholds ascend."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))

    def scorer(self):
        """A function of a list of texts: w.x of each whole text."""
        n = len(self.slots)
        weights = np.concatenate([self.weights, [0.0]])
        place = {int(s): i for i, s in enumerate(self.slots)}
        of = Cached(lambda t: tuple(place.get(s, n) for s in token_slots(t)))
        again = np.array([place.get(s, n) for s in _AGAIN])

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                tokens = (text or "").split()
                if not tokens:
                    continue
                m = len(tokens)
                counts = np.bincount(np.array(list(map(of.__getitem__, tokens)), np.int64).ravel(), minlength=n + 1).astype(float)
                first: dict[str, int] = {}
                at = np.fromiter(map(first.setdefault, tokens, range(m)), np.int64, m)
                marks = [int((at[1:] == at[:-1]).sum()), m - len(first), sum(len(w) - len(set(w)) for w in (x.split() for x in text.split("\n")))]
                np.add.at(counts, again, marks)
                out[i] = weights @ np.sqrt(counts / m)
            return out

        return score


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, most_terms: int = 2048, steps: int = 200, rate: float = 0.08, penalty: float = 3e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model with a squared penalty, by Adam steps.

    Thresholds are a first one and gaps that are exponentials, so their order cannot break. A grade
    without rows gets a threshold between its neighbours'. Without rows every text gets even odds.
    """
    y = np.array([r[0] for r in rows], np.int64)
    k = grades - 1
    slots = select_slots(rows, most_terms)
    x = dense(rows, slots)
    w = np.zeros(len(slots))
    n = max(len(y), 1)
    above = np.array([((y >= j).sum() + 0.5) / (n + 1) for j in range(1, grades)])
    start = -np.log(above / (1 - above)) if len(y) else np.zeros(k)
    first, gaps = np.array([start[0]]), np.log(np.maximum(np.diff(start), 0.05))
    adam = Adam([w, first, gaps], rate)
    for _ in range(steps if len(y) else 0):
        theta = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = (x @ w.astype(np.float32)).astype(float)
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40))), np.zeros((n, 1))], 1)
        rows_ = np.arange(n)
        hi, lo = tail[rows_, y], tail[rows_, y + 1]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gz = -(dhi - dlo) / p / n
        gt = np.zeros(k)  # of each threshold
        np.add.at(gt, y[y > 0] - 1, (dhi / p / n)[y > 0])
        np.add.at(gt, y[y < k], -(dlo / p / n)[y < k])
        tail_sums = np.cumsum(gt[::-1])[::-1]
        adam.step([(gz.astype(np.float32) @ x).astype(float) + penalty * w, np.array([gt.sum()]), tail_sums[1:] * np.exp(gaps)])
    return Ordinal(slots, w.copy(), first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def fit_on(docs: DataFrame, grades_of: DataFrame, grades: int = 3, max_rows: int = 8_000, most_terms: int = 2048) -> Ordinal:
    """Fit on at most ``max_rows`` rated texts; ``grades_of`` has doc_id and `grade` (0 is the lowest).

    ``max_rows`` bounds what reaches the driver. Of several grades of an id the lowest counts; rows
    without one teach nothing.
    """
    lab = grades_of.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("_y"))

    def featurize():
        of = Cached(token_slots)
        return lambda text: shares(text, of)

    return fit(sample(docs, lab, max_rows, featurize), grades, most_terms)


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """Grade 0: bad; 1: good but toxic; 2: good. Without a toxic label a good text has grade 2."""
    return labels.select("doc_id", F.when(F.col("quality") < 1, 0).when((F.col("quality") >= 1) & (F.coalesce("toxic", F.lit(0)) > 0), 1).when(F.col("quality") >= 1, 2).alias("grade"))


def score(df: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """Adds ``expected_grade double`` and ``tails array<double>`` (P(grade >= 1), P(grade >= 2), ...).

    Null counts as an empty text, which has no terms. One pass, no shuffle. Columns of these names, in letters of any
    case, are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = fields_without(df, ("expected_grade", "tails"))
    schema = T.StructType([*keep, T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        scorer = shared.value.scorer()
        for batch in batches:
            tails = shared.value.tails(scorer(batch.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], names=schema.names)

    return df.mapInArrow(run, schema)


#: A document is kept if P(grade >= 1) is this at least.
KEEP = 0.5


def graded_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, most_terms: int = 2048) -> DataFrame:
    """doc_id, expected_grade, p_good (grade 1 or more), p_best (grade 2) and kept of each document.

    Null counts as an empty text, which is graded by the thresholds alone; repeated rows give repeated rows.
    """
    scored = score(docs.select("doc_id", "text"), fit_on(docs, grades_from_labels(labels), 3, max_rows, most_terms))
    return scored.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_best"), (F.col("tails")[0] >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, most_terms: int = 2048) -> DataFrame:
    """The documents that the classifier keeps, with their own columns; null texts are graded as empty ones."""
    model = fit_on(docs, grades_from_labels(labels), 3, max_rows, most_terms)
    # under free names, so that columns of the documents stay
    own = set_aside(docs, ("expected_grade", "tails"))
    scored = score(docs.withColumnsRenamed(own), model).where(F.col("tails")[0] >= KEEP)
    return scored.drop("expected_grade", "tails").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
