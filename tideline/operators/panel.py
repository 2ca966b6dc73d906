"""Panels as they were known at the time, units, features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import rule as R
from tideline.functions import windows as W
from tideline.operators import kernels as K

#: Variables whose level, or whose spread to the target, is a feature.
SPREAD_VARS = ("y2", "ff", "y5", "y30", "be10", "fwd5y5y", "tips10", "clev10")
LEVEL_VARS = ("cpi", "core_cpi", "core_pce", "unrate", "payems", "baa10y", "mich1", "clev10", "be10", "fwd5y5y", "vix")
COMPACT = ("_z3", "_z12", "_spr", "_up", "_down")
LAGS = (1, 3, 6, 12)


def by_month():
    return Window.partitionBy("series_id").orderBy("month")


def known_at(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """The value of each series that was public at the end of each month: that of `pub_lag` months before. `panel` has every month of its span."""
    rows = panel.join(F.broadcast(meta.select(F.col("id").alias("series_id"), "pub_lag")), "series_id", "left")  # a row a series
    rows = rows.withColumn("known", F.add_months("month", F.coalesce("pub_lag", F.lit(0))))
    return panel.select("series_id", "month").join(rows.select("series_id", F.col("known").alias("month"), "value"), ["series_id", "month"], "left")


def realtime(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """known_at, with up to two missing months filled from the last release."""
    return known_at(panel, meta).withColumn("value", W.filled("value", 2))


def info_set(live: DataFrame, month: str) -> DataFrame:
    return live.where(F.col("month") <= F.lit(month).cast("date"))


def level(live: DataFrame, meta: DataFrame) -> DataFrame:
    """Rates as they are, yoy kinds as change on the year in %, prices as 100 times their log."""
    rows = live.join(F.broadcast(meta.select(F.col("id").alias("series_id"), "kind")), "series_id", "left")
    yoy = 100 * (F.col("value") / F.nullif(F.lag("value", 12).over(by_month()), F.lit(0.0)) - 1)
    price = 100 * F.ln(F.when(F.col("value") > 0, F.col("value")))
    kind = F.coalesce("kind", F.lit("rate"))
    return rows.withColumn("value", F.when(kind == "yoy", yoy).when(kind == "price", price).otherwise(F.col("value"))).drop("kind")


def groups(meta: DataFrame, present: DataFrame, exclude: tuple[str, ...] = ("target", "context"), target: str | None = None) -> DataFrame:
    """(group, ids) of the variables that the panel has, without the excluded groups and the target."""
    rows = meta.join(present.select(F.col("series_id").alias("id")).distinct(), "id", "left_semi").where(~F.col("group").isin(*exclude))
    rows = rows.where(F.col("id") != target) if target else rows
    return rows.groupBy("group").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def first_valid(live: DataFrame) -> DataFrame:
    return live.where("value is not null").groupBy("series_id").agg(F.min("month").alias("first_month"))


def own_features(series: DataFrame, live_labels: DataFrame) -> DataFrame:
    """The target's features by t, given its real-time labels (series_id, t, label) of method D."""
    y = F.col("value")
    cols = [(f"d{k}", 100 * W.diff("value", k)) for k in LAGS]
    cols += [("dd12", 100 * (y - W.rolling(F.max, "value", 12))), ("ru12", 100 * (y - W.rolling(F.min, "value", 12))), ("gap12", 100 * (y - W.rolling(F.avg, "value", 12))), ("dy", W.diff("value"))]
    cols += [("vol12", 100 * W.rolling(F.stddev_samp, "dy", 12)), ("vol36", 100 * W.rolling(F.stddev_samp, "dy", 36, 12))]
    vol = F.nullif("vol36", F.lit(0.0))
    cols += [(f"z{k}", F.col(f"d{k}") / (vol * F.sqrt(F.lit(float(k))))) for k in (3, 12)] + [("ddz", F.col("dd12") / vol), ("ruz", F.col("ru12") / vol)]
    rows = W.with_columns(series, cols).drop("dy", "vol36")
    state = W.age(live_labels).select("series_id", "t", (F.col("label") == 1).cast("double").alias("rt_up"), (F.col("label") == -1).cast("double").alias("rt_down"), F.col("age").alias("rt_age"))
    return rows.join(state, ["series_id", "t"])


def x_features(levels: DataFrame, target: DataFrame, states: DataFrame | None = None, level_vars=LEVEL_VARS, spread_vars=SPREAD_VARS) -> DataFrame:
    """Features of other variables by (series_id, month): changes, scaled changes, level, spread to the target (month, value) and trend state (series_id, month, label)."""
    x = F.col("value")
    rows = levels.join(target.select("month", F.col("value").alias("y")), "month", "left")
    change = lambda c, k: F.col(c) - F.lag(c, k).over(by_month())
    cols = [(f"d{k}", change("value", k)) for k in LAGS] + [("dx", change("value", 1)), ("sd", W.rolling(F.stddev_samp, "dx", 36, 12, by_month()))]
    cols += [(f"z{k}", F.col(f"d{k}") / F.nullif(F.col("sd") * F.sqrt(F.lit(float(k))), F.lit(0.0))) for k in (3, 12)]
    cols += [("lvl", F.when(F.col("series_id").isin(*level_vars), x)), ("spr", F.when(F.col("series_id").isin(*spread_vars), F.col("y") - x)), ("spr_d12", change("spr", 12))]
    rows = W.with_columns(rows, cols).drop("dx", "sd", "y")
    if states is None:
        return rows
    known = states.where("label is not null").withColumn("t", F.row_number().over(by_month()))
    state = W.age(known).select("series_id", "month", (F.col("label") == 1).cast("double").alias("up"), (F.col("label") == -1).cast("double").alias("down"), "age")
    return rows.join(state, ["series_id", "month"], "left")


def compact(features: DataFrame) -> DataFrame:
    """The few columns that short samples bear: those with the endings of COMPACT, and the keys."""
    ends = tuple(c[1:] for c in COMPACT)
    return features.select(*[c for c in features.columns if c in ("series_id", "month", "t") or c in ends or c.endswith(COMPACT)])


def matrix(own: DataFrame, x: DataFrame, variables: list[str], columns: list[str]) -> DataFrame:
    """One row a month: the target's features and `v_column` of each variable."""
    wide = own
    for v in variables:
        block = x.where(F.col("series_id") == v).select("month", *[F.col(c).alias(f"{v}_{c}") for c in columns])
        wide = wide.join(block, "month", "left")
    return wide


def causal_sigma(series: DataFrame) -> DataFrame:
    """Adds sig without a look ahead: in the first 24 months, the volatility so far where there are 6 changes, else null."""
    rows = W.with_columns(series, W.sigma())
    sofar = W.expanding(F.stddev_samp, "dy", 6)
    return rows.withColumn("sig", F.when((F.col("t") >= 1) & (F.col("t") <= 24), sofar).otherwise(F.col("sig")))


def trend_state(levels: DataFrame, setting: K.Setting | None = None, warmup: int = 12) -> DataFrame:
    """(series_id, month, label): the real-time state of D on the months that have a value, null in the first `warmup`, and everywhere if there are too few."""
    s = setting or K.Setting(**{k: v for k, v in R.X_TREND.items() if k != "setting_id"})
    rows = causal_sigma(levels.where("value is not null").withColumn("t", (F.row_number().over(by_month()) - 1).cast("int")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = pd.DataFrame({"series_id": pdf["series_id"], "month": pdf["month"], "label": None})
        if len(pdf) > warmup + 2:
            sig = pdf["sig"].to_numpy(float).copy()
            early = sig[: warmup + 1]
            sig[np.isnan(sig)] = np.nanmax(early) if (~np.isnan(early)).any() else 1.0
            live = K.run_machine(pdf["value"].to_numpy(float), K.Rule(s, sig), True)[1].astype(object)
            live[:warmup] = None
            out["label"] = live
        return out

    return rows.select("series_id", "month", "t", "value", "sig").groupBy("series_id").applyInPandas(run, "series_id string, month date, label int")


def macro_momentum(levels: DataFrame, parts: dict[str, int], least: int = 60, enough: int = 3) -> DataFrame:
    """(month, value): mean of the expanding z scores of 12-month changes of the series in `parts` (series -> sign), where `enough` of them are there."""
    sign = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = levels.where(F.col("series_id").isin(*parts)).withColumn("d", sign[F.col("series_id")] * (F.col("value") - F.lag("value", 12).over(by_month())))
    mean, sd = W.expanding(F.avg, "d", least, by_month()), W.expanding(F.stddev_samp, "d", least, by_month())
    rows = rows.withColumn("m", mean).withColumn("s", sd).withColumn("score", (F.col("d") - F.col("m")) / F.nullif("s", F.lit(0.0)))
    return rows.groupBy("month").agg(F.when(F.count("score") >= enough, F.avg("score")).alias("value"))
