"""All scores of many forecasts in one pass, with the horizon as a key.

The months of the truth are joined once to the forecasts for them; runs of truth and of calls, what was hit and what was false are window columns, and one aggregate over
the keys gives every score. Windows and aggregate share one partitioning, by the keys, so no score costs a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.labelers import kappa
from tideline.operators.metrics import CLASSES, calls

PROBABILITIES = ["p_down", "p_side", "p_up"]
#: The scores that a comparison shows for both sides, and those of which it shows the difference.
SIDES = ["bal_acc", "acc", "bss", "brier", "auc_up", "auc_down", "hit_rate", "delay_med", "delay_mean", "within6", "capture", "false_alarms_10y", "precision", "flips_yr", "pnl_bp_yr", "sharpe", "n_events", "n_months"]
DIFFERENCES = ["bal_acc", "bss", "brier", "auc_up", "auc_down", "delay_med", "delay_mean", "hit_rate", "capture", "false_alarms_10y", "precision", "flips_yr", "pnl_bp_yr", "sharpe"]


def judged(made: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each month m of the truth and each run (keys, h) of calls: made (keys, h, t, call, ..) are calls at t for t + h, truth (t, truth, value, and those of the keys that it has).

    Adds prev_call and prev_truth (of the last month with a call), event (the first month of a true trend that begins among the evaluated months), hit, delay and capture of an event, episode (the first
    month of a called trend) and false_alarm of an episode. Months without a call have none; an event is found at the earliest h months after the first call.
    """
    run, on = [*keys, "h"], [k for k in keys if k in truth.columns]
    levels = truth.select(*on, "t", F.col("value").alias("at_origin"))
    made = made.join(levels, [*on, "t"], "left").withColumn("m", F.col("t") + F.col("h"))
    spans = made.groupBy(*run).agg(F.min("t").alias("e0"))
    rows = spans.join(truth.select(*on, F.col("t").alias("m"), "truth", "value"), on).join(made, [*run, "m"], "left")
    by = Window.partitionBy(*run).orderBy("m")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("call").isNotNull()
    rows = rows.withColumns({
        "prev_call": F.last("call", ignorenulls=True).over(past), "prev_truth": F.last(F.when(has, F.col("truth")), ignorenulls=True).over(past),
        "turn": ~F.col("truth").eqNullSafe(F.lag("truth").over(by)), "before": F.lag("value").over(by), "after": F.lead("value").over(by),
    })
    rows = rows.withColumn("called_turn", has & ~F.col("call").eqNullSafe(F.col("prev_call")))
    rows = rows.withColumns({"true_run": F.sum(F.col("turn").cast("int")).over(by), "call_run": F.sum(F.col("called_turn").cast("int")).over(by)})
    one, other = Window.partitionBy(*run, "true_run"), Window.partitionBy(*run, "call_run")
    right = has & (F.col("call") == F.col("truth"))
    rows = rows.withColumns({
        "found": F.min(F.when(right & (F.col("m") >= F.col("e0") + F.col("h")), F.struct("m", "at_origin"))).over(one), "ye": F.max(F.struct("m", "value")).over(one)["value"],
        "any_right": F.max(F.when(right, 1)).over(other),
    })
    event = F.col("turn") & (F.col("truth") != 0) & (F.col("m") >= F.col("e0"))
    origin = F.col("found.m") - F.col("h")
    seen = F.when(origin >= F.col("m") - 1, F.col("found.at_origin")).otherwise(F.col("before"))
    part = F.least(F.greatest((F.col("ye") - seen) / F.nullif(F.col("ye") - F.col("before"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"event": event, "delay": F.when(event, origin - F.col("m")), "capture": F.when(event, F.when(F.col("found").isNull(), 0.0).when(F.col("ye") == F.col("before"), 1.0).otherwise(part))})
    rows = rows.withColumn("episode", F.col("called_turn") & (F.col("call") != 0)).withColumn("false_alarm", F.col("episode") & F.col("any_right").isNull())
    return rows.drop("found", "ye", "any_right", "turn", "called_turn", "true_run", "call_run")


def _share(condition: Column, among: Column) -> Column:
    return F.avg(F.when(among, condition.cast("double")))


def event_aggregates() -> dict[str, Column]:
    """Scores of turning points, over judged rows."""
    has, event = F.col("call").isNotNull(), F.col("event")
    years, episodes, false = F.count_if(has) / 12, F.count_if("episode"), F.count_if("false_alarm")
    late = lambda k: _share(F.coalesce("delay", F.lit(99)) <= k, event)
    flips = lambda now, before: F.count_if(has & (F.col(now) != F.col(before))) / years
    return {
        "n_events": F.count_if(event), "hit_rate": _share(F.col("delay").isNotNull(), event), "delay_med": F.median("delay"), "delay_mean": F.avg("delay"), "within3": late(3), "within6": late(6), "capture": F.avg("capture"),
        "false_alarms_10y": 10 * false / years, "precision": (episodes - false) / F.nullif(episodes, F.lit(0)), "flips_yr": flips("call", "prev_call"), "truth_flips_yr": flips("truth", "prev_truth"),
    }


def event_scores(called: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, scores of turning points, bal_acc) of calls (keys, h, t, call)."""
    recall = [_share(F.col("call") == k, F.col("call").isNotNull() & (F.col("truth") == k)) for k, _ in CLASSES]
    out = judged(called.select(*keys, "h", "t", "call"), truth, keys).groupBy(*keys, "h").agg(*[c.alias(n) for n, c in event_aggregates().items()], F.array(*recall).alias("recall"))
    known = F.filter("recall", lambda x: x.isNotNull())
    return out.withColumn("bal_acc", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))).drop("recall")


def with_calls(forecasts: DataFrame) -> DataFrame:
    """Adds call, the likeliest state; null probabilities count as even."""
    return forecasts.withColumn("call", F.coalesce(F.when(sum((F.col(p).isNull().cast("int") for p in PROBABILITIES), F.lit(0)) == 0, calls()), F.lit(0)))


def scores(forecasts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, all scores) of forecasts (keys, h, t, p_down, p_side, p_up) made at t for t + h; the trading scores for h = 0 only. Scores by month leave out null probabilities, those of turning points take them as even."""
    run = [*keys, "h"]
    rows = judged(with_calls(forecasts).select(*run, "t", *PROBABILITIES, "call"), truth, keys)
    sure = F.col("t").isNotNull()
    for p in PROBABILITIES:
        sure = sure & F.col(p).isNotNull()
    rows = rows.withColumn("sure", sure)
    rank = lambda p: F.rank().over(Window.partitionBy(*run, "sure").orderBy(p)) + (F.count("*").over(Window.partitionBy(*run, "sure", p)) - 1) / 2
    change = F.when((F.col("h") == 0) & F.col("call").isNotNull(), F.col("call") * (F.col("after") - F.col("value")) * 100)
    rows = rows.withColumns({"rank_up": rank("p_up"), "rank_down": rank("p_down"), "pnl": change})
    sure, true, call = F.col("sure"), F.col("truth"), F.col("call")
    loss = sum((F.pow(F.col(p) - (true == k).cast("double"), 2) for k, p in CLASSES), F.lit(0.0))
    own = F.element_at(F.array(*PROBABILITIES), true + 2)
    auc = lambda k, r: F.when((F.count_if(sure & (true == k)) > 0) & (F.count_if(sure & (true != k)) > 0), (F.sum(F.when(sure & (true == k), F.col(r))) - F.count_if(sure & (true == k)) * (F.count_if(sure & (true == k)) + 1) / 2) / (F.count_if(sure & (true == k)) * F.count_if(sure & (true != k))))
    sd = F.stddev_samp("pnl")
    aggs = {
        "n_months": F.count_if(sure), "acc": _share(call == true, sure), "brier": F.avg(F.when(sure, loss)), "logscore": F.avg(F.when(sure, -F.ln(F.least(F.greatest(own, F.lit(1e-6)), F.lit(1.0))))), "auc_up": auc(1, "rank_up"), "auc_down": auc(-1, "rank_down"),
        "pnl_bp_yr": 12 * F.avg("pnl"), "sharpe": F.when(sd > 0, F.sqrt(F.lit(12.0)) * F.avg("pnl") / sd), "hit": F.avg(F.when(call != 0, F.when(F.col("pnl").isNotNull(), (F.col("pnl") > 0).cast("double")))), "exposure": F.avg(F.when(F.col("pnl").isNotNull(), (call != 0).cast("double"))),
    } | event_aggregates()
    for k, p in CLASSES:
        aggs |= {f"ap_{p}": F.count_if(sure & (true == k)), f"pp_{p}": F.count_if(sure & (call == k)), f"tp_{p}": F.count_if(sure & (call == k) & (true == k))}
    out = rows.groupBy(*run).agg(*[c.alias(n) for n, c in aggs.items()])
    n = F.nullif(F.col("n_months"), F.lit(0))
    recall = [F.when(F.col(f"ap_{p}") > 0, F.col(f"tp_{p}") / F.col(f"ap_{p}")) for _, p in CLASSES]
    f1 = [F.when(F.col(f"ap_{p}") > 0, 2 * F.col(f"tp_{p}") / (F.col(f"pp_{p}") + F.col(f"ap_{p}"))) for _, p in CLASSES]
    mean = lambda cs: sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)) / F.nullif(sum((c.isNotNull().cast("int") for c in cs), F.lit(0)), F.lit(0))
    chance = sum((F.col(f"pp_{p}") * F.col(f"ap_{p}") for _, p in CLASSES), F.lit(0.0)) / (n * n)
    climate = 1 - sum((F.pow(F.col(f"ap_{p}") / n, 2) for _, p in CLASSES), F.lit(0.0))
    out = out.withColumns({"bal_acc": mean(recall), "macro_f1": mean(f1), "kappa": kappa(F.col("acc"), chance, F.lit(None).cast("double")), "bss": 1 - F.col("brier") / F.nullif(climate, F.lit(0.0))})
    months = ["n_months", "acc", "bal_acc", "macro_f1", "kappa", "brier", "bss", "logscore", "auc_up", "auc_down"]
    return out.select(*run, *months, *event_aggregates(), "pnl_bp_yr", "sharpe", "hit", "exposure")


def delays(forecasts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, event, delay): each event by its first month, with how long after it the forecasts called it; null if never."""
    return judged(with_calls(forecasts).select(*keys, "h", "t", "call"), truth, keys).where("event").select(*keys, "h", F.col("m").alias("event"), "delay")


# ---- tests on paired months


def dm_columns(d: Column, h: Column) -> tuple[Column, Column]:
    """(mean, Diebold-Mariano statistic) of an array of differences in order of time: Bartlett weights to lag h + 11 and the small-sample factor; the statistic is null if the variance isn't positive."""
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    top = F.least(h + 11, n - 1)
    centred = F.transform(d, lambda x: x - mean)
    product = lambda k: F.aggregate(F.zip_with(F.slice(centred, k + 1, n - k), F.slice(centred, F.lit(1), n - k), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    weighted = F.transform(F.sequence(F.lit(0), top), lambda k: F.when(k == 0, 1.0).otherwise(2 * (1 - k / (top + 1))) * product(k))
    variance = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x) / n
    factor = F.sqrt((n + 1 - 2 * (h + 1) + (h + 1) * h / n) / n)
    return F.when(n > 0, mean), F.when((n > 1) & (variance > 0), mean / F.sqrt(variance / n) * factor)


def draw_table(rows: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """`rows` with `draw` from 0: each row once a draw."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("seed", F.lit(seed))


def start_of(draw: Column, block: Column, choices: Column, seed: Column) -> Column:
    """The first month of a block: a digest of seed, draw and block, taken as a share of the months that a block can start at."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), draw.cast("string"), block.cast("string")).cast("binary")), 1, 8), 16, 10)
    return F.floor(digest.cast("double") / 4294967296.0 * choices).cast("int")


def bootstrap(rows: DataFrame, keys: list[str], draws: int = 500, block: int = 24, seed: int = 0) -> DataFrame:
    """(keys, ci_low, ci_high, p_boot) of the difference in balanced accuracy between two calls over moving-block resamples of rows (keys, t, truth, call_a, call_b).

    Nine counts (months of each state, and those that either call has right) are summed up along each series once. A block is then the difference of two such sums, and a draw adds a few of them:
    its cost doesn't grow with the block's length. Draws are rows, so tasks share them; blocks start where a digest of the draw's and the block's number says.
    """
    states = F.array(*[F.lit(k) for k, _ in CLASSES])
    flags = F.concat(*[F.transform(states, f) for f in (lambda k: (F.col("truth") == k).cast("long"), lambda k: ((F.col("truth") == k) & (F.col("call_a") == k)).cast("long"), lambda k: ((F.col("truth") == k) & (F.col("call_b") == k)).cast("long"))])
    by = Window.partitionBy(*keys).orderBy("t")
    upto = F.array(*[F.sum(F.col("flags")[k]).over(by) for k in range(9)])
    none = F.array(*[F.lit(0).cast("long")] * 9)
    sums = rows.withColumn("flags", flags).withColumn("upto", upto).groupBy(*keys).agg(F.concat(F.array(none), F.transform(F.array_sort(F.collect_list(F.struct("t", "upto"))), lambda x: x["upto"])).alias("sums"))
    sums = sums.withColumn("n", F.size("sums") - 1).withColumn("width", F.least(F.lit(block), F.col("n"))).withColumn("blocks", F.ceil(F.col("n") / F.col("width")).cast("int"))
    drawn = draw_table(sums, draws, seed)

    def counts(i: Column) -> Column:
        first = start_of(F.col("draw"), i, F.col("n") - F.col("width") + 1, F.col("seed"))
        length = F.least(F.col("width"), F.col("n") - i * F.col("width"))  # the last block only as far as months are missing
        return F.zip_with(F.get(F.col("sums"), first + length), F.get(F.col("sums"), first), lambda b, a: b - a)

    total = F.aggregate(F.sequence(F.lit(0), F.col("blocks") - 1), none, lambda s, i: F.zip_with(s, counts(i), lambda a, b: a + b))
    drawn = drawn.withColumn("c", total).select(*keys, "c")
    present = [F.col("c")[k] > 0 for k in range(3)]
    gained = sum((F.when(p, (F.col("c")[3 + k] - F.col("c")[6 + k]) / F.col("c")[k]).otherwise(0.0) for k, p in enumerate(present)), F.lit(0.0))
    drawn = drawn.select(*keys, (gained / sum((p.cast("int") for p in present), F.lit(0))).alias("gain"))
    return drawn.groupBy(*keys).agg(F.percentile("gain", F.lit(0.05)).alias("ci_low"), F.percentile("gain", F.lit(0.95)).alias("ci_high"), F.avg((F.col("gain") <= 1e-12).cast("double")).alias("p_boot"))
