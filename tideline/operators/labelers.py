"""The eleven labelings over many series and settings at once, and what is read off labels and segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import rule as R
from tideline.functions import windows as W
from tideline.operators import kernels as K

LABELS = "series_id string, setting_id string, method string, t int, label int"
SEGMENTS = "series_id string, setting_id string, method string, seg_no int, start int, end int, label int, confirm int, open boolean, imp double"
SETTING = [f for f in K.Setting.__dataclass_fields__]


def with_sigma(series: DataFrame, full: bool = False) -> DataFrame:
    """Adds dy and sig, the rule's volatility, to (series_id, t, value)."""
    return W.with_columns(series, W.sigma(full))


def with_settings(series: DataFrame, settings: DataFrame) -> DataFrame:
    """Each series under each setting, with the volatility that the setting asks for."""
    both = with_sigma(series).withColumn("sig_full", F.stddev_samp("dy").over(Window.partitionBy("series_id")))
    out = both.crossJoin(F.broadcast(settings))  # a grid of settings, thousands at most
    return out.withColumn("sig", F.when(F.col("sigma") == "full", F.col("sig_full")).otherwise(F.col("sig"))).drop("sig_full")


def _setting(pdf: pd.DataFrame) -> K.Setting:
    r = pdf.iloc[0]
    return K.Setting(**{f: type(getattr(K.Setting, f))(r[f]) for f in SETTING})


def _grouped(rows: DataFrame, kernel, shape: str, *extra: str) -> DataFrame:
    """Applies kernel(y, setting, sigma, frame) -> dict of columns to each series and setting, in order of t."""
    names = [x.split()[0] for x in shape.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = kernel(pdf["value"].to_numpy(float), _setting(pdf), pdf["sig"].to_numpy(float), pdf)
        frame = pd.DataFrame(out)
        for k in ("series_id", "setting_id", *extra):
            frame[k] = pdf[k].iloc[0]
        return frame.reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    return rows.select("series_id", "setting_id", *extra, "t", "value", "sig", *SETTING).groupBy("series_id", "setting_id", *extra).applyInPandas(run, shape)


def machine_labels(series: DataFrame, settings: DataFrame, methods: tuple[str, ...] = ("A", "A_rt", "B", "D", "D_rt", "E", "E_rt", "F", "F_rt", "G")) -> DataFrame:
    """Labels by month for (series_id, t, value) and a settings table; every group of a series and a setting is independent."""

    def kernel(y, s, sig, _):
        got, _ = K.label_all(y, s, sig, methods)
        return {"method": np.repeat(list(got), len(y)), "t": np.tile(np.arange(len(y)), len(got)), "label": np.concatenate([got[m] for m in got])}

    return _grouped(with_settings(series, settings), kernel, LABELS)


def machine_segments(series: DataFrame, settings: DataFrame, methods: tuple[str, ...] = K.EX_POST) -> DataFrame:
    """Segments of the ex-post methods."""

    def kernel(y, s, sig, _):
        _, got = K.label_all(y, s, sig, methods)
        rows = [(m, k, g.start, g.end, g.label, g.confirm, g.open, g.imp) for m in got for k, g in enumerate(got[m])]
        return dict(zip(("method", "seg_no", "start", "end", "label", "confirm", "open", "imp"), map(list, zip(*rows)))) if rows else {}

    return _grouped(with_settings(series, settings), kernel, SEGMENTS)


def end_states(series: DataFrame, settings: DataFrame, legs: bool = True) -> DataFrame:
    """Where machine A (legs False) or D stands after the last month."""

    def kernel(y, s, sig, _):
        fin = K.run_machine(y, K.Rule(s, sig), legs)[2]
        return {k: [v] for k, v in fin.items()}

    return _grouped(with_settings(series, settings), kernel, "series_id string, setting_id string, state int, ext int, seg_start int, imp_top double")


def levels(series: DataFrame, settings: DataFrame, kind: str) -> DataFrame:
    """The smooth levels behind E (kind `kalman`) and F (`l1`, `l1_live`)."""
    if kind == "kalman":
        return _grouped(with_settings(series, settings), lambda y, s, g, p: {"t": np.arange(len(y)), **K.kalman(y, s.kalman_lam)}, "series_id string, setting_id string, t int, filt double, fslope double, smooth double, sslope double")
    fit = (lambda y, s: K.l1_trend(y, s.l1_lam)[0]) if kind == "l1" else (lambda y, s: K.l1_live(y, s.l1_lam))
    return _grouped(with_settings(series, settings), lambda y, s, g, p: {"t": np.arange(len(y)), "level": fit(y, s)}, "series_id string, setting_id string, t int, level double")


def pieces(series: DataFrame, settings: DataFrame) -> DataFrame:
    """The optimal piecewise-linear fit behind B."""

    def kernel(y, s, sig, _):
        got = K.piecewise(y, K.penalty(y) * s.thr**2)
        return {"piece_no": range(len(got)), "start": [p[0] for p in got], "end": [p[1] for p in got], "slope": [p[2] for p in got]}

    return _grouped(with_settings(series, settings), kernel, "series_id string, setting_id string, piece_no int, start int, end int, slope double")


def method_c(series: DataFrame, settings: DataFrame, length: int = 12, least: int = 3) -> DataFrame:
    """Rolling regression, in window expressions throughout: the fitted move over the last `length` months against the rule; runs under `least` months (or the
    setting's minimum) take the label before. That looks ahead to the end of a run: see method_c_causal."""
    rows = _c_raw(series, settings, length)
    by = Window.partitionBy("series_id", "setting_id")
    changed = F.when(F.col("raw").eqNullSafe(F.lag("raw").over(by.orderBy("t"))), 0).otherwise(1)
    rows = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(by.orderBy("t")))
    size = F.count("*").over(Window.partitionBy("series_id", "setting_id", "_run"))
    kept = F.when((size >= F.greatest(F.lit(least), F.col("min_len"))) | (F.col("_run") == 1), F.col("raw"))
    return rows.withColumn("_kept", kept).select("series_id", "setting_id", F.lit("C").alias("method"), "t", F.last("_kept", ignorenulls=True).over(by.orderBy("t")).cast("int").alias("label"))


def method_c_causal(series: DataFrame, settings: DataFrame, length: int = 12, least: int = 3) -> DataFrame:
    """As method_c, but a run counts only once it has reached its minimum length, so no label depends on later months."""
    rows = _c_raw(series, settings, length)
    by = Window.partitionBy("series_id", "setting_id")
    changed = F.when(F.col("raw").eqNullSafe(F.lag("raw").over(by.orderBy("t"))), 0).otherwise(1)
    rows = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(by.orderBy("t")))
    nth = F.row_number().over(Window.partitionBy("series_id", "setting_id", "_run").orderBy("t"))
    kept = F.when((nth >= F.greatest(F.lit(least), F.col("min_len"))) | (F.col("_run") == 1), F.col("raw"))
    return rows.withColumn("_kept", kept).select("series_id", "setting_id", F.lit("C_causal").alias("method"), "t", F.last("_kept", ignorenulls=True).over(by.orderBy("t")).cast("int").alias("label"))


def _c_raw(series: DataFrame, settings: DataFrame, length: int) -> DataFrame:
    rows = with_settings(series.withColumn("_slope", W.slope("value", "t", length)), settings)
    move = F.col("_slope") * (length - 1)
    raw = F.when(F.col("_slope").isNull(), 0).otherwise(R.label(move, R.required(F.lit(0), F.lit(length - 1), F.col("sig")), eps=0.0))
    # the rule's minimum length concerns endpoint moves only
    return rows.withColumn("raw", raw)


def expand(segments: DataFrame) -> DataFrame:
    """Labels by month of segments: months start+1 to end; month 0 has the first segment's."""
    months = F.sequence(F.when(F.col("start") == 0, 0).otherwise(F.col("start") + 1), F.col("end"))
    return segments.where("end > start or start = 0").select("series_id", "setting_id", "method", F.explode(months).alias("t"), "label")


def collapse(labels: DataFrame) -> DataFrame:
    """Segments of labels: each run starts at the month before it."""
    keys = ("series_id", "setting_id", "method")
    return W.runs(labels, "label", keys).select(*keys, F.col("run_no").alias("seg_no"), F.greatest(F.col("first") - 1, F.lit(0)).alias("start"), F.col("last").alias("end"), "label")


def decorated(segments: DataFrame, series: DataFrame, settings: DataFrame) -> DataFrame:
    """Segments with dates, levels, change and required move in hundredths (half to even), months and score."""
    at = with_settings(series, settings).select("series_id", "setting_id", "t", "month", "value", "sig", "thr", "scaled", "z", "cap")
    a = at.select("series_id", "setting_id", F.col("t").alias("start"), F.col("month").alias("start_date"), F.col("value").alias("y0"))
    b = at.withColumnsRenamed({"t": "end", "month": "end_date", "value": "y1", "z": "zz"})
    rows = segments.join(a, ["series_id", "setting_id", "start"]).join(b, ["series_id", "setting_id", "end"])
    score = R.zscore(F.col("y1") - F.col("y0"), F.col("start"), F.col("end"), F.col("sig"))
    rows = rows.withColumn("chg_bp", F.bround((F.col("y1") - F.col("y0")) * 100).cast("long")).withColumn("months", F.col("end") - F.col("start")).withColumn("score", score).withColumn("z", F.col("zz"))
    return rows.withColumn("req_bp", F.bround(100 * R.required(F.col("start"), F.col("end"), F.col("sig"))).cast("long")).drop("zz", "thr", "scaled", "cap", "z", "sig")


def latest(segments: DataFrame, k: int = 1) -> DataFrame:
    """The last k segments of each series, setting and method."""
    n = F.row_number().over(Window.partitionBy("series_id", "setting_id", "method").orderBy(F.col("seg_no").desc()))
    return segments.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def in_state_since(labels: DataFrame) -> DataFrame:
    """(keys, label, since): the last run's label and first month."""
    keys = ("series_id", "setting_id", "method")
    return W.runs(labels, "label", keys).groupBy(*keys).agg(F.max_by(F.struct("label", "first"), "run_no").alias("r")).select(*keys, F.col("r.label").alias("label"), F.col("r.first").alias("since"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Shares of states, numbers of segments by state and mean months of trends (0 if there are none)."""
    keys = ["series_id", "setting_id", "method"]
    share = lambda k: F.avg((F.col("label") == k).cast("int"))
    months = labels.groupBy(*keys).agg(share(1).alias("share_up"), share(0).alias("share_side"), share(-1).alias("share_down"))
    one = lambda k: F.count_if(F.col("label") == k)
    trend = F.when(F.col("label") != 0, F.col("end") - F.col("start"))
    segs = collapse(labels).groupBy(*keys).agg(F.count("*").alias("n_segments"), one(1).alias("n_up"), one(-1).alias("n_down"), one(0).alias("n_side"), F.coalesce(F.avg(trend), F.lit(0.0)).alias("avg_trend_months"))
    return months.join(segs, keys)


def agreement(labels: DataFrame) -> DataFrame:
    """(series_id, setting_id, a, b, agree, kappa) for every pair of methods."""
    keys = ["series_id", "setting_id", "t"]
    both = labels.select(*keys, F.col("method").alias("a"), F.col("label").alias("x")).join(labels.select(*keys, F.col("method").alias("b"), F.col("label").alias("y")), keys)
    share = lambda c, k: F.avg((F.col(c) == k).cast("int"))
    by_chance = sum((share("x", k) * share("y", k) for k in (-1, 0, 1)), F.lit(0.0))
    out = both.groupBy("series_id", "setting_id", "a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("agree"), by_chance.alias("pe"))
    return out.withColumn("kappa", kappa(F.col("agree"), F.col("pe"), F.lit(1.0))).drop("pe")


def kappa(po: Column, pe: Column, if_certain: Column) -> Column:
    return F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(if_certain)


def detection_lags(segments: DataFrame, live: DataFrame) -> DataFrame:
    """How long after the start of each trend of `segments` the live labels agree with it: n, detected, median, mean."""
    trends = segments.where("label <> 0").select("series_id", "setting_id", F.col("method").alias("truth"), "seg_no", "start", "end", F.col("label").alias("d"))
    pairs = trends.join(live, ["series_id", "setting_id"])
    hit = F.min(F.when((F.col("t") > F.col("start")) & (F.col("t") <= F.col("end")) & (F.col("label") == F.col("d")), F.col("t") - F.col("start")))
    each = pairs.groupBy("series_id", "setting_id", "truth", "method", "seg_no").agg(hit.alias("lag"))
    return each.groupBy("series_id", "setting_id", "truth", "method").agg(F.count("*").alias("n"), F.count("lag").alias("detected"), F.median("lag").alias("median"), F.avg("lag").alias("mean"))


def triggers(series: DataFrame, settings: DataFrame, states: DataFrame, legs: bool = True) -> DataFrame:
    """What next month's value would have to be to change each machine's state, and the range since its segment began.

    Sideways: the least rise over any start that would be a trend, and the least fall. In a trend: the level at which it reverses.
    """
    rows = with_settings(series, settings).join(states, ["series_id", "setting_id"])
    whole = Window.partitionBy("series_id", "setting_id")
    rows = rows.withColumn("n", F.count("*").over(whole).cast("int")).withColumn("sig_n", F.last("sig").over(whole.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.col("t") >= F.col("seg_start")
    start = inside & (F.col("t") <= F.col("n") - F.greatest(F.col("min_len"), F.lit(1))) & (F.col("state") == 0)
    need = R.required(F.col("t"), F.col("n"), F.col("sig_n"))
    at_ext = F.col("t") == F.col("ext")
    reverse = R.required(F.col("ext"), F.col("n"), F.col("sig_n"))
    if legs:
        reverse = F.greatest(F.col("floor") * reverse, F.col("rho") * F.col("state") * (F.col("value") - F.col("imp_top")))
    flip = F.max(F.when(at_ext & (F.col("state") != 0), F.col("value") - F.col("state") * reverse))
    return rows.groupBy("series_id", "setting_id", "state", "seg_start").agg(
        F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high"),
        F.min(F.when(start, F.col("value") + need)).alias("up_trigger"), F.max(F.when(start, F.col("value") - need)).alias("down_trigger"), flip.alias("flip_level"))


def settled_end(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """(keys, settled): the first month of the open, last segment; all months where there is only one."""
    last = segments.groupBy("series_id", "setting_id", "method").agg(F.max("start").alias("s"), F.count("*").alias("k"))
    return last.join(lengths, "series_id").select("series_id", "setting_id", "method", F.when(F.col("k") > 1, F.col("s") + 1).otherwise(F.col("n")).cast("int").alias("settled"))


def vintages(series: DataFrame, ends: DataFrame) -> DataFrame:
    """Every series as it was at each month of `ends` (T): rows up to T. series_id becomes `id@T`, so any labeler takes it."""
    cut = ends.select(F.col("T").alias("vintage"))
    rows = series.join(F.broadcast(cut), F.col("t") <= F.col("vintage"))  # a few refit dates
    return rows.withColumn("base_id", F.col("series_id")).withColumn("series_id", F.concat_ws("@", "series_id", F.col("vintage").cast("string")))
