"""Quality rules as a learned decision list: statistics, sequential covering, Spark conditions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.llm.common import durable, fields_without, hash_of_id, labelled_sample

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts that rules may use; all are taken over the whole text.
MORE = ["n_lines", "n_upper", "n_digits", "n_distinct", "top_word", "longest_run"]
#: What conditions are learned on: shares of the counts above, and the length itself.
FEATURES: dict[str, tuple[str, str | None]] = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "top_word_share": ("top_word", "n_words"),
    "run_share": ("longest_run", "n_words"),
}
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; the window is a power of two.

    Windows are named by pairs of windows of half their length, so names are equal only where all
    words are. Only windows both of whose halves recur can recur themselves.
    """
    n = len(ids)
    if n <= window:
        return 0
    name = np.where(np.bincount(ids, minlength=n)[ids] > 1, ids, -1).astype(np.int64)
    span = 1
    while span < window:
        at = np.flatnonzero((name[: n - 2 * span + 1] >= 0) & (name[span : n - span + 1] >= 0))
        if not at.size:
            return 0
        _, named, seen = np.unique(name[at] * n + name[at + span], return_inverse=True, return_counts=True)
        again = seen[named] > 1
        name = np.full(n, -1, np.int64)
        name[at[again]] = named[again]
        span *= 2
    at = np.flatnonzero(name >= 0)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> list[int]:
    """COUNTS and MORE of one whole text; a null text counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at the six ASCII spaces, and only there
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    run = 0
    if n:
        change = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        run = int(np.diff(change).max())
    chars = len(text or "") - sum((text or "").count(c) for c in _SPACES)
    return [
        n,
        chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        sum(map(str.isupper, text or "")) if not raw.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"0123456789")),
        len(first),
        int(np.bincount(ids).max()) if n else 0,
        run,
    ]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns and the counts of the whole text, one row for each row; no shuffle.

    Columns that have the name of a count, in letters of any case, are replaced.
    """
    made = [*COUNTS, *MORE]
    keep = fields_without(df, [*made, text_col])
    schema = T.StructType(keep + [T.StructField(c, T.LongType()) for c in made])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(text_col)], np.int64).reshape(-1, len(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(rows[:, i]) for i in range(len(made)))], names=schema.names)

    return df.mapInArrow(count, schema)


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top).cast("double") if under is None else F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is the value above, threshold) and the verdict for rows that meet it."""

    conditions: tuple[tuple[str, bool, float], ...]
    verdict: bool

    def met(self) -> Column:
        return reduce(lambda a, b: a & b, [(feature(f) > F.lit(t)) if above else (feature(f) <= F.lit(t)) for f, above, t in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions) + f" -> {'keep' if self.verdict else 'reject'}"


def as_column(rules: list[Rule], default: bool = True) -> Column:
    """The list as one ordered conditional expression: the first rule that is met decides."""
    if not rules:
        return F.lit(default)
    chain = F.when(rules[0].met(), F.lit(rules[0].verdict))
    for r in rules[1:]:
        chain = chain.when(r.met(), F.lit(r.verdict))
    return chain.otherwise(F.lit(default))


def learn(values: np.ndarray, good: np.ndarray, names: list[str], min_precision: float = 0.95, min_rows: int = 5, max_conditions: int = 4, steps: int = 48) -> list[Rule]:
    """Sequential covering: grow a conjunction for bad rows, prune it, remove what it covers, go on.

    Every third row is kept from growing and used for pruning. Growing adds the condition of the
    largest information gain; pruning cuts from the end while the difference of covered bad and good
    rows, as a share, does not fall. A rule enters the list if ``min_precision`` of the rows it
    covers in both parts are bad and it covers ``min_rows`` of them at least.
    """
    left, rules, n = np.ones(len(good), bool), [], len(good)
    hold = np.arange(n) % 3 == 2
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, steps + 1)[1:-1])) if n else np.empty(0) for j in range(values.shape[1])]
    while True:
        grow = left & ~hold
        covered, conditions = grow.copy(), []
        while len(conditions) < max_conditions and (covered & good).any():
            bad_now, now = int((covered & ~good).sum()), int(covered.sum())
            if not bad_now:
                break
            best = (0.0, None)
            rows = np.flatnonzero(covered)
            bad_rows = ~good[rows]
            for j, at in enumerate(cuts):
                v = values[rows, j]
                order = np.argsort(v, kind="stable")
                bads = np.concatenate([[0], np.cumsum(bad_rows[order])])
                k = np.searchsorted(v[order], at, "right")  # rows at or below each cut
                for above in (False, True):
                    bad, all_ = (bads[-1] - bads[k], len(rows) - k) if above else (bads[k], k)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(bad > 0, bad * (np.log2(bad / np.maximum(all_, 1)) - np.log2(bad_now / now)), 0)
                    if gain.size and gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), (j, above, float(at[int(gain.argmax())])))
            if best[1] is None:
                break
            j, above, t = best[1]
            conditions.append(best[1])
            covered &= (values[:, j] > t) if above else (values[:, j] <= t)

        def cover(conds, base):
            for j, above, t in conds:
                base = base & ((values[:, j] > t) if above else (values[:, j] <= t))
            return base

        def worth(conds):
            c = cover(conds, left & hold)
            p, m = int((c & ~good).sum()), int((c & good).sum())
            return (p - m) / (p + m) if p + m else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        c = cover(conditions, left)
        bad, total = int((c & ~good).sum()), int(c.sum())
        if not conditions or bad < min_rows or bad < min_precision * total:
            return rules
        rules.append(Rule(tuple((names[j], above, t) for j, above, t in conditions), False))
        left &= ~c


def learned_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_precision: float = 0.95) -> list[Rule]:
    """Rules from the statistics of labelled rows (`quality` 1: good).

    At most ``max_rows`` of the ids that have a label and a row reach the driver: those of the least hash,
    the same ones each time. Where labels of one id differ the lower one counts, of rows that share an id the
    one of the least counts; rows without a label or id teach nothing. Without bad rows the list is empty.
    """
    names = list(FEATURES)
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    lab = labelled_sample(stats, lab, max_rows)
    counts = [*COUNTS, *MORE]
    each = stats.join(F.broadcast(lab), "doc_id").groupBy("doc_id", "_good").agg(F.min(F.struct(*counts)).alias("_s")).select("doc_id", "_good", "_s.*")
    taken = each.orderBy(hash_of_id(), "doc_id")
    rows = taken.select("_good", *(feature(f).alias(f"_f{i}") for i, f in enumerate(names))).collect()
    values = np.array([r[1:] for r in rows], float).reshape(-1, len(names))
    return learn(values, np.array([r[0] > 0 for r in rows], bool), names, min_precision)


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each document.

    A document fails the base if it has fewer than 20 words or more than 30 of 100 words lie in
    windows that recur; the learned list decides about the others. Null texts have no words. The
    counts are taken once, in one pass, and written before rules are learned on them.
    """
    stats = durable(with_statistics(docs.select("doc_id", "text")))
    rules = learned_rules(stats, labels, max_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & as_column(rules)).alias("kept"))
