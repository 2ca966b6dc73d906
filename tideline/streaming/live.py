"""Streams: monthly buckets as they close, and the real-time states of methods A and D."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators import kernels as K
from tideline.operators.tables import folder

OUT = "series_id string, month date, t int, label int"


def monthly(events: DataFrame, ts: str, value: Column, key: Column, late: str = "31 days") -> DataFrame:
    """(series_id, month, value, n): monthly means of an event stream; in append mode a month comes out once the watermark has passed it, so a bucket that is still filling never does."""
    rows = events.select(key.alias("series_id"), F.date_trunc("month", ts).alias("month_ts"), value.cast("double").alias("v")).withWatermark("month_ts", late)
    return rows.groupBy("series_id", "month_ts").agg(F.avg("v").alias("value"), F.count("v").alias("n")).select("series_id", F.to_date("month_ts").alias("month"), "value", "n")


class Follower:
    """A machine that reads months one by one and keeps only what later months can ask for: at most `max(cap, min_len, stall)` and one months, and the last 36 changes.

    Volatility is causal: of the changes so far in the first 24 months, where there are 6.
    """

    def __init__(self, setting: K.Setting, legs: bool):
        self.setting, self.legs = setting, legs
        self.t, self.last_month, self.y, self.sigma, self.changes = -1, "", [], [], []
        self.machine = None

    def new_machine(self) -> K.Machine:
        return K.Machine(K.Rule(self.setting, self.sigma), self.legs, 12 if self.legs else 6)

    def read(self, value: float) -> int:
        if self.y:
            self.changes.append(value - self.y[-1])
        self.t += 1
        d = self.changes[-36:]
        self.changes = d
        self.y.append(value)
        self.sigma.append(float(np.std(d, ddof=1)) if len(d) >= 6 else float("nan"))
        if self.machine is None:
            self.machine = self.new_machine()
            return 0
        m = self.machine
        m.rule = K.Rule(self.setting, self.sigma)
        m.step(np.asarray(self.y), len(self.y) - 1)
        drop = min(m.needed(), len(self.y) - 1)
        if drop > 0:
            self.y, self.sigma = self.y[drop:], self.sigma[drop:]
            m.shifted(drop)
        return m.state

    def parts(self) -> tuple[dict, list[tuple[float, float | None]]]:
        """(what is one value each, the kept months as (value, volatility))"""
        m = self.machine
        one = {"t": self.t, "last_month": self.last_month, "changes": [float(c) for c in self.changes], "state": None if m is None else int(m.state)}
        if m is not None:
            one |= {k: int(getattr(m, k)) for k in m.MONTHS} | {k: float(getattr(m, k)) for k in m.LEVELS}
        return one, [(float(v), None if s != s else float(s)) for v, s in zip(self.y, self.sigma)]

    def restored(self, one: dict, months: list) -> Follower:
        self.t, self.last_month, self.changes = one["t"], one["last_month"], list(one["changes"])
        self.y, self.sigma = [m[0] for m in months], [float("nan") if m[1] is None else m[1] for m in months]
        if one["state"] is not None:
            self.machine = self.new_machine()
            self.machine.state = one["state"]
            for k in (*K.Machine.MONTHS, *K.Machine.LEVELS):
                setattr(self.machine, k, one[k])
        return self

    def dump(self) -> str:
        return json.dumps(self.parts())

    def load(self, text: str) -> Follower:
        return self.restored(*json.loads(text))


def live_states(months: DataFrame, setting: K.Setting, legs: bool = True) -> DataFrame:
    """The state of each series as its months arrive (series_id, month, value). Months that aren't after a series' last one, and null values, are passed over: a machine can't be
    rewound. A series' state doesn't grow, however long a trend or a sideways box lasts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Follower(setting, legs)
        if state.exists:
            f.load(state.get[0])
        rows = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("month")
        out = []
        for month, value in zip(rows["month"], rows["value"]):
            if str(month) > f.last_month:
                label = f.read(float(value))
                f.last_month = str(month)
                out.append((key[0], month, f.t, label))
        state.update((f.dump(),))
        yield pd.DataFrame(out, columns=["series_id", "month", "t", "label"]).astype({"t": "int32", "label": "int32"})

    return months.select("series_id", "month", "value").groupBy("series_id").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now, and reads what it wrote."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def replay(table: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """A stream of a table's rows, in `parts` micro-batches or fewer of consecutive ranges of `order`, a date or timestamp; rows of equal or null `order` share a batch.

    Ranges end at approximate quantiles. All have the same number of files, so that a trigger takes just one range; no task needs more than a part of one."""
    spark, path = table.sparkSession, folder(table.sparkSession, "stream")
    at = F.col(order).cast("timestamp").cast("double")
    ends = sorted(set(table.select(at.alias("at")).approxQuantile("at", [k / parts for k in range(1, parts)], 0.01)))
    part = F.coalesce(sum(((at > F.lit(e)).cast("int") for e in ends), F.lit(0)), F.lit(0))
    kept = table.withColumn("_p", part)
    counts = sorted((r[0], r[1]) for r in kept.groupBy("_p").count().collect())
    # Rows are dealt in turn: of a source partition with `files` rows or more each file has some. An empty file would not be written.
    sources = max(1, table.rdd.getNumPartitions())
    files = max(1, min([int(spark.conf.get("spark.sql.shuffle.partitions")), *(n // sources for _, n in counts)]))
    for k, _ in counts:
        rows = kept.where(F.col("_p") == k).drop("_p")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    if not counts:
        table.limit(0).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
