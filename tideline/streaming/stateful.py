"""Streams whose state is several values and lists with an expiry, and a step loop that writes each batch once.

A series' machine is one value and a list of the few months that it may still look at; a called state under confirmation is one value. Both are kept by Spark's state store for
transformWithState, and expire if a series stays silent for longer than asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators import kernels as K
from tideline.operators import walkforward as G
from tideline.streaming.live import Follower, drain

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MACHINE = "t int, last_month string, changes array<double>, state int, " + ", ".join([f"{k} int" for k in K.Machine.MONTHS] + [f"{k} double" for k in K.Machine.LEVELS])
NAMES = [c.split()[0] for c in MACHINE.split(", ")]


def _ttl(expiry: timedelta | None) -> int | None:
    return None if expiry is None else int(expiry.total_seconds() * 1000)


class MachineState(StatefulProcessor):
    """The machine of one series: `machine` is what it is apart from months, `months` those that it may still look at."""

    def __init__(self, setting: K.Setting, legs: bool, expiry: timedelta | None):
        self.setting, self.legs, self.expiry = setting, legs, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", MACHINE, _ttl(self.expiry))
        self.months = handle.getListState("months", "value double, sigma double", _ttl(self.expiry))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        f = Follower(self.setting, self.legs)
        if self.machine.exists():
            one = dict(zip(NAMES, self.machine.get()))
            f.restored(one, list(self.months.get()))
        new, out = pd.concat(list(rows)).dropna(subset=["value"]).sort_values("month"), []
        for month, value in zip(new["month"], new["value"]):
            if str(month) > f.last_month:
                label = f.read(float(value))
                f.last_month = str(month)
                out.append((key[0], month, f.t, label))
        if out:
            one, months = f.parts()
            self.machine.update(tuple(one.get(n) for n in NAMES))
            self.months.put(months)
        yield pd.DataFrame(out, columns=["series_id", "month", "t", "label"]).astype({"t": "int32", "label": "int32"})

    def close(self) -> None:
        pass


class Confirmed(StatefulProcessor):
    """A called state that changes only to a likeliest state of probability theta or more."""

    def __init__(self, expiry: timedelta | None):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.called = handle.getValueState("called", "t int, call int", _ttl(self.expiry))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last, call = self.called.get() if self.called.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).fillna({p: 1 / 3 for p in ("p_down", "p_side", "p_up")}).sort_values("t").itertuples():
            if last is not None and r.t <= last:
                continue
            p = [r.p_down, r.p_side + 1e-9, r.p_up]
            top = max(range(3), key=lambda k: (p[k], -k))
            if call is None or key[1] <= 0 or (r.p_down, r.p_side, r.p_up)[top] >= key[1]:
                call = top - 1
            last = int(r.t)
            out.append((key[0], key[1], last, call))
        if out:
            self.called.update((last, call))
        yield pd.DataFrame(out, columns=["series_id", "theta", "t", "call"]).astype({"theta": "float64", "t": "int32", "call": "int32"})

    def close(self) -> None:
        pass


def machine_states(months: DataFrame, setting: K.Setting, legs: bool = True, expiry: timedelta | None = None) -> DataFrame:
    """(series_id, month, t, label): the real-time state of each series as its months arrive (series_id, month, value). Months that aren't after a series' last one, and null values, are passed over. After `expiry` without a month a series starts anew."""
    kind = "none" if expiry is None else "processingTime"
    rows = months.select("series_id", "month", "value").groupBy("series_id")
    return rows.transformWithStateInPandas(MachineState(setting, legs, expiry), "series_id string, month date, t int, label int", "append", kind)


def confirmed_calls(forecasts: DataFrame, expiry: timedelta | None = None) -> DataFrame:
    """(series_id, theta, t, call) of a stream of forecasts (series_id, theta, t, p_down, p_side, p_up): the first call, and any at a theta of 0 or less, is the likeliest state. Null probabilities count as even; a month that isn't after the last one is passed over."""
    kind = "none" if expiry is None else "processingTime"
    rows = forecasts.select("series_id", F.col("theta").cast("double").alias("theta"), "t", "p_down", "p_side", "p_up").groupBy("series_id", "theta")
    return rows.transformWithStateInPandas(Confirmed(expiry), "series_id string, theta double, t int, call int", "append", kind)


def drained(stream: DataFrame) -> DataFrame:
    """drain() with the state store that these streams need; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        return drain(stream)
    finally:
        conf.unset(STORE[0]) if before is None else conf.set(STORE[0], before)


# ---- a step loop


def step_loop(rows: DataFrame, bounds: DataFrame, detectors: list, setting: K.Setting, path: str, horizons: tuple[int, ...] = (0, 3), every: int = 12, after: Callable[[int], None] | None = None) -> DataFrame:
    """Steps through a stream of months (series_id, t, value, sig, features) and forecasts each from what has come by then; gives the forecasts as they are under `path` afterwards.

    bounds (series_id, e0, e1). Each micro-batch is kept in a folder of its number, and its forecasts in another one; a batch that runs again after a failure writes both again, so that every month is there once,
    whatever failed and however often. A detector is refitted every `every` months from the one before e0. `after` is called with a batch's number when its forecasts are written, and before the stream knows.
    """
    spark = rows.sparkSession
    kinds, kept, made = rows.schema, f"{path}/months", f"{path}/forecasts"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        history = session.read.schema(kinds).option("basePath", kept).parquet(*[f"{kept}/batch={k}" for k in range(number + 1)])
        new = session.read.schema(kinds).parquet(f"{kept}/batch={number}").join(bounds, "series_id").where("t >= e0 and t <= e1")
        refit = F.col("e0") - 1 + F.floor((F.col("t") - F.col("e0")) / every).cast("int") * every
        spans = new.select("series_id", refit.cast("int").alias("refit"), "t").groupBy("series_id", "refit").agg(F.max("t").alias("last"), F.min("t").alias("first"))
        out = G.run(history, spans.select("series_id", "refit", "last"), detectors, setting, horizons)
        out = out.join(spans.select("series_id", "refit", "first"), ["series_id", "refit"]).where("t >= first").drop("first")
        out.write.mode("overwrite").parquet(f"{made}/batch={number}")
        if after:
            after(number)

    q = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(G.FORECASTS).parquet(made).drop("batch")
