"""The trend rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-12
#: The settings tables that studies and pages start from.
DEFAULT = {"setting_id": "default", "thr": 1.0, "scaled": True, "z": 2.0, "min_len": 3, "cap": 12, "rho": 0.618, "floor": 1.0}
FIXED100 = DEFAULT | {"setting_id": "fixed100", "scaled": False, "min_len": 0}
X_TREND = DEFAULT | {"setting_id": "x_trend", "thr": 0.0}
SCHEMA = "setting_id string, thr double, scaled boolean, z double, min_len int, sigma string, cap int, rho double, floor double, kalman_lam double, l1_lam double"


def settings(spark: SparkSession, *rows: dict) -> DataFrame:
    """A row for each setting, defaults filled in; a number stands for a fixed threshold."""
    base = {"setting_id": "fixed", "thr": 1.0, "scaled": False, "z": 2.0, "min_len": 0, "sigma": "rolling", "cap": 12, "rho": 0.618, "floor": 1.0, "kalman_lam": 1000.0, "l1_lam": 5.0}
    full = [base | (r if isinstance(r, dict) else {"setting_id": f"fixed{r:g}", "thr": float(r)}) for r in rows]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def required(a: Column, b: Column, sig_b: Column) -> Column:
    """The move required from month a to month b, given sigma at b and the setting's columns."""
    scaled = F.greatest(F.col("thr"), F.col("z") * sig_b * F.sqrt(F.least(F.greatest(b - a, F.lit(1)), F.col("cap")).cast("double")))
    return F.when(F.col("scaled"), scaled).otherwise(F.col("thr"))


def long_enough(a: Column, b: Column) -> Column:
    return b - a >= F.col("min_len")


def label(move: Column, need: Column, eps: float = EPS) -> Column:
    return F.when(move >= need - eps, 1).when(move <= eps - need, -1).otherwise(0)


def rule_label(move: Column, a: Column, b: Column, sig_b: Column) -> Column:
    """Label of the move from a to b by its endpoints."""
    return F.when(long_enough(a, b), label(move, required(a, b, sig_b))).otherwise(0)


def zscore(move: Column, a: Column, b: Column, sig_b: Column) -> Column:
    return F.abs(move) / F.nullif(sig_b * F.sqrt(F.greatest(b - a, F.lit(1)).cast("double")), F.lit(0.0))


def required_table(latest: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12, 24)) -> DataFrame:
    """(.., months, req_bp): the move required over each horizon that ends at the row's month, in hundredths."""
    rows = latest.withColumn("months", F.explode(F.array(*map(F.lit, horizons))))
    return rows.withColumn("req_bp", F.round(100 * required(F.lit(0), F.col("months"), F.col("sig"))).cast("long"))
