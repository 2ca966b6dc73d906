"""How well forecasts of states (p_down, p_side, p_up by t) and called states do against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import windows as W
from tideline.operators.labelers import kappa

CLASSES = ((-1, "p_down"), (0, "p_side"), (1, "p_up"))


def calls(down: str = "p_down", side: str = "p_side", up: str = "p_up") -> Column:
    """The likeliest state; ties go to sideways, then to down."""
    s = F.col(side) + 1e-9
    return F.when((F.col(down) >= s) & (F.col(down) >= F.col(up)), -1).when(s >= F.col(up), 0).otherwise(1)


def onehot(label: str = "label") -> list[Column]:
    """p_down, p_side, p_up of a state; all null if it is null."""
    return [F.when(F.col(label).isNotNull(), (F.col(label) == k).cast("double")).alias(p) for k, p in CLASSES]


def hysteresis_calls(forecasts: DataFrame, theta: Column, keys: tuple[str, ...]) -> DataFrame:
    """Adds call: a called state changes only to a likeliest state of probability theta or more; the first row, and any theta of 0 or less, takes the likeliest one."""
    by = Window.partitionBy(*keys).orderBy("t")
    rows = forecasts.withColumn("_top", calls()).withColumn("_p", F.greatest("p_down", "p_side", "p_up"))
    firm = (F.row_number().over(by) == 1) | (theta <= 0) | (F.element_at(F.array("p_down", "p_side", "p_up"), F.col("_top") + 2) >= theta)
    return rows.withColumn("_firm", F.when(firm, F.col("_top"))).withColumn("call", F.last("_firm", ignorenulls=True).over(by)).drop("_top", "_p", "_firm")


def auc(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, auc) by ranks with ties averaged; null if there is one class only."""
    rows = rows.withColumn("_r", W.average_rank(score, keys)).withColumn("_p", positive)
    n1, n0 = F.count_if("_p"), F.count_if(~F.col("_p"))
    return rows.groupBy(*keys).agg(F.when((n1 > 0) & (n0 > 0), (F.sum(F.when(F.col("_p"), F.col("_r"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def month_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of (keys, t, p_down, p_side, p_up, truth), rows with a null probability left out."""
    rows = rows.dropna(subset=["p_down", "p_side", "p_up"]).withColumn("c", calls())
    of = F.element_at(F.array("p_down", "p_side", "p_up"), F.col("truth") + 2)
    brier = sum(((F.col(p) - (F.col("truth") == k).cast("double")) * (F.col(p) - (F.col("truth") == k).cast("double")) for k, p in CLASSES), F.lit(0.0))
    share = lambda c: F.avg(c.cast("double"))
    aggs = [F.count("*").alias("n_months"), share(F.col("c") == F.col("truth")).alias("acc"), F.avg(brier).alias("brier"), F.avg(-F.ln(F.least(F.greatest(of, F.lit(1e-6)), F.lit(1.0)))).alias("logscore")]
    for k, p in CLASSES:
        aggs += [F.count_if(F.col("truth") == k).alias(f"ap_{p}"), F.count_if(F.col("c") == k).alias(f"pp_{p}"), F.count_if((F.col("c") == k) & (F.col("truth") == k)).alias(f"tp_{p}")]
    out = rows.groupBy(*keys).agg(*aggs)
    n = F.col("n_months")
    recall = [F.when(F.col(f"ap_{p}") > 0, F.col(f"tp_{p}") / F.col(f"ap_{p}")) for _, p in CLASSES]
    f1 = [F.when(F.col(f"ap_{p}") > 0, 2 * F.col(f"tp_{p}") / (F.col(f"pp_{p}") + F.col(f"ap_{p}"))) for _, p in CLASSES]
    mean = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)) / sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    pe = sum((F.col(f"pp_{p}") * F.col(f"ap_{p}") for _, p in CLASSES), F.lit(0.0)) / (n * n)
    climate = 1 - sum((F.pow(F.col(f"ap_{p}") / n, 2) for _, p in CLASSES), F.lit(0.0))
    out = out.withColumn("bal_acc", mean(recall)).withColumn("macro_f1", mean(f1)).withColumn("kappa", kappa(F.col("acc"), pe, F.lit(None).cast("double"))).withColumn("bss", 1 - F.col("brier") / F.nullif(climate, F.lit(0.0)))
    up = auc(rows, keys, "p_up", F.col("truth") == 1).withColumnRenamed("auc", "auc_up")
    down = auc(rows, keys, "p_down", F.col("truth") == -1).withColumnRenamed("auc", "auc_down")
    return out.join(up, keys).join(down, keys).select(*keys, "n_months", "acc", "bal_acc", "macro_f1", "kappa", "brier", "bss", "logscore", "auc_up", "auc_down")


def trend_events(truth: DataFrame, keys: list[str], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """(keys, event, start, end, dir): runs of a trend whose first month is within bounds."""
    ev = W.runs(truth, "truth", tuple(keys)).where("truth <> 0")
    ev = ev.where(F.col("first") >= lo) if lo is not None else ev
    ev = ev.where(F.col("first") <= hi) if hi is not None else ev
    return ev.select(*keys, F.col("run_no").alias("event"), F.col("first").alias("start"), F.col("last").alias("end"), F.col("truth").alias("dir"))


def event_delays(called: DataFrame, truth: DataFrame, keys: list[str], h: int = 0) -> DataFrame:
    """(keys, event, start, end, dir, delay, capture) for calls (keys, t, call) made at t for t + h, truth (keys, t, truth, value) inside the evaluated months."""
    bounds = called.groupBy(*keys).agg(F.min(F.col("t") + h).alias("lo"))
    ev = trend_events(truth, keys).join(bounds, keys)
    at = called.select(*keys, (F.col("t") + h).alias("m"), "call")
    hits = ev.join(at, keys).where("m >= start and m <= end and call = dir and m >= lo").groupBy(*keys, "event").agg(F.min("m").alias("hit"))
    v = truth.select(*keys, "t", "value")
    level = lambda name, at: v.withColumnsRenamed({"t": at, "value": name})
    out = ev.join(hits, [*keys, "event"], "left").withColumn("origin", F.col("hit") - h).withColumn("before", F.col("start") - 1).withColumn("seen", F.greatest("origin", "before"))
    out = out.join(level("y0", "before"), [*keys, "before"], "left").join(level("ye", "end"), [*keys, "end"], "left").join(level("yd", "seen"), [*keys, "seen"], "left")
    part = F.least(F.greatest((F.col("ye") - F.col("yd")) / F.nullif(F.col("ye") - F.col("y0"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    capture = F.when(F.col("hit").isNull(), 0.0).when(F.col("ye") == F.col("y0"), 1.0).otherwise(part)
    return out.select(*keys, "event", "start", "end", "dir", (F.col("origin") - F.col("start")).alias("delay"), capture.alias("capture"))


def false_alarms(called: DataFrame, truth: DataFrame, keys: list[str], h: int = 0) -> DataFrame:
    """Called episodes that overlap no true trend of their direction."""
    target = called.select(*keys, (F.col("t") + h).alias("t"), "call")
    eps = W.runs(target, "call", tuple(keys)).where("call <> 0")
    true = truth.select(*keys, F.col("t").alias("m"), "truth")
    near = eps.join(true, keys).where("m >= first and m <= last and truth = call").select(*keys, "run_no").distinct()
    return eps.join(near, [*keys, "run_no"], "left_anti")


def pnl_metrics(called: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Trading the call against the next month's change (keys, t, value): long when down is called."""
    by = Window.partitionBy(*keys).orderBy("t")
    nxt = values.withColumn("dv", F.lead("value").over(by) - F.col("value")).select(*keys, "t", "dv")
    rows = called.join(nxt, [*keys, "t"]).where("dv is not null").withColumn("pnl", F.col("call") * F.col("dv") * 100)
    sd = F.stddev_samp("pnl")
    return rows.groupBy(*keys).agg((12 * F.avg("pnl")).alias("pnl_bp_yr"), F.when(sd > 0, F.sqrt(F.lit(12.0)) * F.avg("pnl") / sd).alias("sharpe"), F.avg(F.when(F.col("call") != 0, (F.col("pnl") > 0).cast("double"))).alias("hit"), F.avg((F.col("call") != 0).cast("double")).alias("exposure"))


def dm_statistic(rows: DataFrame, keys: list[str], h: int = 0) -> DataFrame:
    """Diebold-Mariano statistic of the mean of d (keys, t, d), with Bartlett weights to lag h + 11 and the small-sample factor: (keys, n, mean_d, stat)."""
    by = Window.partitionBy(*keys)
    rows = rows.where("d is not null").withColumn("i", F.row_number().over(by.orderBy("t"))).withColumn("n", F.count("*").over(by)).withColumn("dc", F.col("d") - F.avg("d").over(by))
    lags = rows.select(*keys, F.col("i").alias("i0"), F.col("dc").alias("dk")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(h + 11)))).withColumn("i", F.col("i0") + F.col("k"))
    pairs = rows.join(lags, [*keys, "i"]).withColumn("top", F.least(F.lit(h + 11), F.col("n") - 1)).where("k <= top")
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("top") + 1)))
    lrv = pairs.groupBy(*keys, "n").agg((F.sum(weight * F.col("dc") * F.col("dk")) / F.col("n")).alias("lrv"))
    mean = rows.groupBy(*keys).agg(F.avg("d").alias("mean_d"))
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * (h + 1) + (h + 1) * h / n) / n)
    return lrv.join(mean, keys).select(*keys, "n", "mean_d", F.when(F.col("lrv") > 0, F.col("mean_d") / F.sqrt(F.col("lrv") / n) * factor).alias("stat"))
