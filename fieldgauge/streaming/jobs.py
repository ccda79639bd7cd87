"""The two incremental jobs: a census of new inputs, and persistence errors with frames that wait for their neighbours as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def write_batch(rows: DataFrame, batch: int, out: str) -> None:
    """The rows of a batch in a folder of its own: a batch that is run again replaces what it left before."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """What all batches have written."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def incremental_census(spark: SparkSession, schema, source: str, out: str, checkpoint: str, transform) -> None:
    """Census of each new file of a folder (T1): inputs that a former run has taken are not read again.

    Output and checkpoint belong together. A batch that failed between its write and its commit is replayed under
    its number and replaces its own folder, so each input is in the output once; see `read_batches`.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(lambda batch, number: write_batch(transform(batch), number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAIRED = "file string, trajectory int, field string, t int, persistence_mse double"


class _Frame:
    """Sites and values of a frame, and whether it has met its neighbours."""

    def __init__(self, sites, xs, before: bool = False, after: bool = False):
        self.sites, self.xs, self.before, self.after = np.asarray(sites, np.int64), np.asarray(xs, float), before, after

    def error(self, last: "_Frame") -> float | None:
        """Mean squared difference over the sites that both have; None if there is none."""
        _, a, b = np.intersect1d(self.sites, last.sites, return_indices=True)
        return float(np.mean((self.xs[a] - last.xs[b]) ** 2)) if len(a) else None

    def row(self) -> tuple:
        return self.sites.tolist(), self.xs.tolist(), self.before, self.after


class _Pairs(StatefulProcessor):
    """Frames wait until both neighbours have come, or until ``late`` frames newer than they are known."""

    def __init__(self, late: int | None):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "t int", "sites array<bigint>, xs array<double>, before boolean, after boolean")
        self.newest = handle.getValueState("newest", "t int")

    def _of(self, t: int, here: dict) -> _Frame | None:
        if t not in here and self.waiting.containsKey((t,)):
            here[t] = _Frame(*self.waiting.getValue((t,)))
        return here.get(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for chunk in rows:
            here, out = {}, []  # the frames of this chunk, and those that wait for one of them
            for t, sites, xs in zip(chunk["t"].tolist(), chunk["sites"], chunk["xs"], strict=True):
                newest = t if newest is None else max(newest, t)
                if self._of(t, here) is None:
                    here[t] = _Frame(sites, xs)
                now, last, after = here[t], self._of(t - 1, here), self._of(t + 1, here)
                for a, b, at in ((last, now, t), (now, after, t + 1)):
                    if a is not None and b is not None and not (a.after and b.before):
                        a.after = b.before = True
                        error = b.error(a)
                        if error is not None:
                            out.append((*key, at, error))
            for t, frame in here.items():
                if frame.before and frame.after:
                    self.waiting.removeKey((t,))
                else:
                    self.waiting.updateValue((t,), frame.row())
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PAIRED.split(", ")])
        self.newest.update((newest,))
        if self.late is not None:
            for (t,) in [k for k in self.waiting.keys() if k[0] < newest - self.late]:
                self.waiting.removeKey((t,))

    def close(self) -> None:
        pass


def persistence_stream(frames: DataFrame, late: int | None = None) -> DataFrame:
    """Persistence errors of a stream of frames (file, trajectory, field, t, cells of site and x), in any order.

    A frame waits in the state of its trajectory and field until the frames before and after it have come, so the result is
    that of the batch operator however frames are dealt over batches; without gaps only the first and the last
    frame and those out of order wait. ``late`` bounds that: a frame is given up once one more than ``late`` frames newer is known.
    Cells are matched by site; sites that only one of two neighbouring frames has, and null cells, do not count. A frame that
    comes again while it waits is ignored. Uses the RocksDB state store, which is set for the session.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    there = F.filter("cells", lambda c: c["x"].isNotNull())
    flat = frames.select("file", "trajectory", "field", F.col("t").cast("int").alias("t"), F.transform(there, lambda c: c["site"].cast("bigint")).alias("sites"), F.transform(there, lambda c: c["x"].cast("double")).alias("xs"))
    return flat.groupBy("file", "trajectory", "field").transformWithStateInPandas(_Pairs(late), _PAIRED, "append", "none")


def one_step_forecasts(windows: DataFrame, model, out: str = "pred double") -> DataFrame:
    """Scores windows (with `inputs`) by a user's ``model(list of inputs) -> list of next values`` in batches."""
    schema = ", ".join(f"{n} {t}" for n, t in windows.dtypes) + f", {out}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out.split()[0]: model([list(x) for x in b["inputs"]])})

    return windows.mapInPandas(run, schema)


def rollout_forecasts(frames: DataFrame, model, steps: int, history: int = 4, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Autoregressive rollout of each trajectory from its first frames (F6); a site that lacks one of them gives none.

    All sites of a trajectory go through the model together, once a step: it is given a list with the last ``history``
    values of each site and returns the next one of each. It sees values less ``mean`` over ``std``; results are scaled back.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.pivot_table(index="site", columns="t", values="x", aggfunc="last").reindex(columns=range(history)).dropna()
        seen = [((first[t] - mean) / std).to_numpy() for t in range(history)]
        made = []
        for k in range(steps if len(first) else 0):
            nxt = np.asarray(model(np.stack(seen[-history:], axis=1).tolist()), float)
            seen.append(nxt)
            made.append(pd.DataFrame({"file": key[0], "trajectory": key[1], "site": first.index, "rollout_step": k + 1, "pred": nxt * std + mean}))
        return pd.concat(made) if made else pd.DataFrame(columns=["file", "trajectory", "site", "rollout_step", "pred"])

    return frames.where(F.col("t") < history).groupBy("file", "trajectory").applyInPandas(run, "file string, trajectory int, site bigint, rollout_step int, pred double")


def conditioning_monitor(events: DataFrame, eps: float, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Variance, floor share and band of each event-time window and type; late events beyond the delay are left out."""
    from fieldgauge.functions import band, floor_share

    agg = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.var_samp("value").alias("var"), F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "var", floor_share(F.col("var"), eps).alias("share"), band(floor_share(F.col("var"), eps)).alias("band"))
