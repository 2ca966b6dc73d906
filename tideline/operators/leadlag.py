"""Which series turns first, and the trade of delay against false alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import windows as W
from tideline.operators import labelers as L
from tideline.operators import metrics as M
from tideline.operators import scoring as C
from tideline.sources.series import numbered

#: Series that move against the target.
INVERTED = ("unrate", "baa10y", "vix")


def own_truth(levels: DataFrame, settings: DataFrame, least: int = 40) -> DataFrame:
    """(series_id, t, month, label): ex-post labels of D of each variable on the months that it has, where these are more than `least`."""
    rows = numbered(levels)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).where(F.col("n") > least).drop("n")
    labels = L.machine_labels(rows, settings, ("D",)).select("series_id", "t", "label")
    return labels.join(rows.select("series_id", "t", "month"), ["series_id", "t"])


def turns(labels: DataFrame) -> DataFrame:
    """(series_id, t, dir): first months of trends, a series' first run left out."""
    return W.runs(labels).where("label <> 0 and run_no > 0").select("series_id", F.col("first").alias("t"), F.col("label").alias("dir"))


def all_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x, y): every series of x with every other one of y. For a few series; a study of many names its pairs."""
    a, b = x.select(F.col("series_id").alias("x")).distinct(), y.select(F.col("series_id").alias("y")).distinct()
    return a.crossJoin(b).where("x <> y")


def nearest_turns(x: DataFrame, y: DataFrame, pairs: DataFrame, within: int = 12) -> DataFrame:
    """(x, y, t, dir, lead): for each turn of y the nearest of x in the same direction, the earlier of two as near, for the pairs (x, y) listed; lead is negative where x turned first.

    The turns of a series are one row, so the joins are on series alone, and the search is within a pair's two lists.
    """
    listed = lambda turns, name, of: turns.groupBy(F.col("series_id").alias(name)).agg(F.collect_list(F.struct("t", "dir")).alias(of))
    both = pairs.join(listed(x, "x", "tx"), "x").join(listed(y, "y", "ty"), "y").withColumn("b", F.explode("ty"))
    lead = lambda a: a["t"] - F.col("b.t")
    near = F.filter("tx", lambda a: (a["dir"] == F.col("b.dir")) & (F.abs(lead(a)) <= within))
    best = F.array_min(F.transform(near, lambda a: F.struct(F.abs(lead(a)).alias("d"), lead(a).alias("lead"))))
    return both.select("x", "y", F.col("b.t").alias("t"), F.col("b.dir").alias("dir"), best["lead"].alias("lead")).where("lead is not null")


STATES = ("down", "side", "up")


def packed(labels: DataFrame) -> DataFrame:
    """(series_id, down, side, up): the months t in each state as bits, 64 to a number, month 0 the lowest of the first."""
    bit = F.expr("shiftleft(1L, cast(pmod(t, 64) as int))")
    words = labels.where("label is not null").groupBy("series_id", F.expr("t div 64").alias("word")).agg(*[F.bit_or(F.when(F.col("label") == k, bit).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in zip((-1, 0, 1), STATES)])
    held = words.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct(*STATES)))).alias("m"), F.max("word").alias("top"))
    filled = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda w: F.coalesce(F.try_element_at(F.col("m"), w)[n], F.lit(0).cast("long")))
    return held.select("series_id", *[filled(n).alias(n) for n in STATES])


def concordance(x: DataFrame, y: DataFrame, pairs: DataFrame, reach: int = 12, least: int = 60) -> DataFrame:
    """(x, y, lag, share) of months t in which x's label equals y's at t + lag, for the pairs (x, y) listed and lags with more than `least` months; reach: 63 at most.

    Labels are bits (see packed), so a lag is a shift and a comparison of two series a few conjunctions and bit counts.
    """
    a = packed(x).select(F.col("series_id").alias("x"), *[F.col(n).alias(f"a_{n}") for n in STATES])
    b = packed(y).select(F.col("series_id").alias("y"), *[F.col(n).alias(f"b_{n}") for n in STATES])
    both = pairs.join(a, "x").join(b, "y").withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    word = lambda array, i: f"coalesce(get({array}, {i}), 0L)"
    moved = lambda array, by: f"if({by} <= 0, {word(array, 'i')}, shiftrightunsigned({word(array, 'i')}, greatest({by}, 0)) | shiftleft({word(array, 'i + 1')}, 64 - greatest({by}, 1)))"
    same = " + ".join(f"bit_count({moved(f'a_{n}', '-lag')} & {moved(f'b_{n}', 'lag')})" for n in STATES)
    known = lambda side, by: "(" + " | ".join(moved(f"{side}_{n}", by) for n in STATES) + ")"
    words = "sequence(0, least(size(a_up), size(b_up)) - 1)"
    total = lambda of: F.expr(f"aggregate({words}, 0, (s, i) -> s + {of})")
    both = both.withColumns({"same": total(same), "n": total(f"bit_count({known('a', '-lag')} & {known('b', 'lag')})")})
    return both.where(F.col("n") > least).select("x", "y", "lag", (F.col("same") / F.col("n")).alias("share"))


def lead_lag(x: DataFrame, y: DataFrame, pairs: DataFrame | None = None, inverted: tuple[str, ...] = INVERTED) -> DataFrame:
    """(x, y): matched turns, share of them that x led, median and mean lead, concordance at lag 0, and the lag of the best one (the least of equals); for the pairs (x, y) listed, all if there is no list."""
    pairs = all_pairs(x, y) if pairs is None else pairs
    x = x.withColumn("label", F.when(F.col("series_id").isin(*inverted), -F.col("label")).otherwise(F.col("label")))
    near = nearest_turns(turns(x), turns(y), pairs).groupBy("x", "y").agg(F.count("*").alias("matched"), F.avg((F.col("lead") < 0).cast("double")).alias("led"), F.median("lead").alias("lead_med"), F.avg("lead").alias("lead_mean"))
    conc = concordance(x, y, pairs).groupBy("x", "y").agg(F.max(F.when(F.col("lag") == 0, F.col("share"))).alias("share0"), F.max(F.struct("share", (-F.col("lag")).alias("neg"))).alias("b"))
    return conc.select("x", "y", "share0", F.col("b.share").alias("best_share"), (-F.col("b.neg")).alias("best_lag")).join(near, ["x", "y"], "left")


#: The thresholds of a frontier.
THETAS = (0.0, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)


def frontier(forecasts: DataFrame, truth: DataFrame, thetas: tuple[float, ...] = THETAS, keys: tuple[str, ...] = ("series_id",), plain: tuple[str, ...] = ()) -> DataFrame:
    """Scores of turning points and balanced accuracy of hysteresis calls by (keys, theta, h), for forecasts (keys, h, t, probabilities); detectors named in `plain`, whose calls are certain, only at the first threshold."""
    rows = forecasts.fillna(1 / 3, subset=C.PROBABILITIES).withColumn("theta", F.explode(F.array(*map(F.lit, thetas))))
    rows = rows.where((F.col("theta") == thetas[0]) | ~F.col("detector").isin(*plain)) if plain else rows
    called = M.hysteresis_calls(rows, F.col("theta"), (*keys, "h", "theta"))
    return C.event_scores(called, truth, [*keys, "theta"])
