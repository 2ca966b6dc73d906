"""Scores and comparisons of a few detectors' forecasts; `matrix` runs the whole study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import matrix as X
from tideline.operators import scoring as C
from tideline.operators.tables import written


def scored(forecasts: DataFrame, truth: DataFrame, h: int = 0) -> DataFrame:
    """All scores by (series_id, detector) of forecasts at horizon h; truth is (series_id, t, truth, value)."""
    return leaderboard(forecasts, truth, (h,)).drop("h")


def leaderboard(forecasts: DataFrame, truth: DataFrame, horizons: tuple[int, ...] = (0, 3)) -> DataFrame:
    """All scores by (series_id, detector, h)."""
    return C.scores(forecasts.where(F.col("h").isin(*horizons)), truth, ["series_id", "detector"])


def all_against(forecasts: DataFrame, truth: DataFrame, pairs: list[tuple[str, str]], h: int = 0, draws: int = 500) -> DataFrame:
    """(series_id, a, b, h, differences and tests) for a list of pairs of detectors, all in one plan; the forecasts are written first, as scores and tests both read them."""
    made = written(forecasts.where(F.col("h") == h).withColumn("tier", F.lit("-")), "pairs")
    rows = [{"study": "-", "var": "-", "members": [], "label": "-", "tier": "-", "family": "-", "aug": a, "base": b} for a, b in pairs]
    out = X.compared(made, truth, C.scores(made, truth, X.RUN), X.pair_table(forecasts.sparkSession, rows), draws)
    tests = ["dm_brier_diff", "p_dm", "ci_low", "ci_high", "p_boot", "p_wilcoxon_delay"]
    return out.select("series_id", F.col("aug").alias("a"), F.col("base").alias("b"), "h", *[f"d_{c}" for c in C.DIFFERENCES], *tests)


def compare(forecasts: DataFrame, truth: DataFrame, a: str, b: str, h: int = 0, draws: int = 500) -> DataFrame:
    """Detector a against b on the same months, by series."""
    return all_against(forecasts, truth, [(a, b)], h, draws)


def best_model(board: DataFrame, metric: str = "bss", h: int = 0) -> DataFrame:
    """(series_id, detector, metric) of the best model at a horizon; the first by name of equal ones."""
    first = Window.partitionBy("series_id").orderBy(F.col(metric).desc_nulls_last(), "detector")
    return board.where(F.col("h") == h).withColumn("n", F.row_number().over(first)).where("n = 1").select("series_id", "detector", metric)


def significant(comparisons: DataFrame, level: float = 0.1, top: int = 3) -> DataFrame:
    """Gains in Brier skill with p below `level`, most certain first."""
    return comparisons.where((F.col("p_dm") < level) & (F.col("d_bss") > 0)).orderBy("p_dm").limit(top)
