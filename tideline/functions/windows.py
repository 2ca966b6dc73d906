"""Window expressions over (series_id, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_t():
    return Window.partitionBy("series_id").orderBy("t")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x, k: int = 1, by=None) -> Column:
    return F.lag(col(x), k).over(by or by_t())


def diff(x, k: int = 1, by=None) -> Column:
    return col(x) - lag(x, k, by)


def rolling(agg, x, rows: int, least: int | None = None, by=None) -> Column:
    """An aggregate of the last `rows` rows where at least `least` (all, by default) have a value."""
    w = (by or by_t()).rowsBetween(1 - rows, 0)
    return F.when(F.count(col(x)).over(w) >= (least or rows), agg(col(x)).over(w))


def expanding(agg, x, least: int, by=None) -> Column:
    w = (by or by_t()).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(col(x)).over(w) >= least, agg(col(x)).over(w))


def slope(y, x, rows: int, by=None) -> Column:
    """Least-squares slope over the last `rows` rows."""
    w = (by or by_t()).rowsBetween(1 - rows, 0)
    return F.when(F.count(col(y)).over(w) >= rows, F.regr_slope(col(y), col(x)).over(w))


def filled(x, steps: int, order: str = "month") -> Column:
    """The last value of up to `steps` rows before, only up to the last row that has one."""
    all_ = Window.partitionBy("series_id")
    w = all_.orderBy(order)
    last = F.max(F.when(col(x).isNotNull(), F.col(order))).over(all_)
    return F.when(F.col(order) <= last, F.last(col(x), ignorenulls=True).over(w.rowsBetween(-steps, 0)))


def sigma(full: bool = False, y: str = "value") -> list[tuple[str, Column]]:
    """Columns to add in turn for the rule's volatility `sig`: of the last 36 changes, of the first 24 where there are fewer than 24, or of all."""
    every = Window.partitionBy("series_id")
    last36 = by_t().rowsBetween(-35, 0)
    seed = F.stddev_samp(F.when((F.col("t") >= 1) & (F.col("t") <= 24), F.col("dy"))).over(every)
    rolled = F.when(F.count("dy").over(last36) >= 24, F.stddev_samp("dy").over(last36)).otherwise(seed)
    return [("dy", diff(y)), ("sig", F.stddev_samp("dy").over(every) if full else rolled)]


def with_columns(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, c in steps:
        df = df.withColumn(name, c)
    return df


def run_ids(df: DataFrame, label: str = "label", keys: tuple[str, ...] = ("series_id",), order: str = "t") -> DataFrame:
    """Adds run_no, from 0: runs of equal labels in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = df.withColumn("_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1))
    return changed.withColumn("run_no", (F.sum("_new").over(w) - 1).cast("int")).drop("_new")


def runs(df: DataFrame, label: str = "label", keys: tuple[str, ...] = ("series_id",), order: str = "t") -> DataFrame:
    """(keys, run_no, label, first, last): the runs themselves."""
    return run_ids(df, label, keys, order).groupBy(*keys, "run_no", label).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def age(df: DataFrame, label: str = "label", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds age: log(1 + rows since the label last changed)."""
    w = Window.partitionBy(*keys, "run_no").orderBy("t")
    return run_ids(df, label, keys).withColumn("age", F.log1p((F.row_number().over(w) - 1).cast("double"))).drop("run_no")


def without_short_runs(df: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Runs under `least` rows, except a series' first, take the label of the nearest longer run before."""
    marked = run_ids(df, label)
    size = F.count("*").over(Window.partitionBy("series_id", "run_no"))
    kept = F.when((size >= least) | (F.col("run_no") == 0), F.col(label))
    return marked.withColumn("_kept", kept).withColumn(label, F.last("_kept", ignorenulls=True).over(by_t())).drop("_kept", "run_no")


def average_rank(score: str, keys: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(score)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2
