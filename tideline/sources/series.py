"""Sources and sinks of monthly series in long form: (series_id, month, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = "series_id string, month date, value double"
META_DEFAULTS = {"group": "user", "kind": "rate", "unit": ""}


def month_of(ts) -> Column:
    return F.trunc(F.col(ts) if isinstance(ts, str) else ts, "MM")


def read_csv(spark: SparkSession, path: str, date_col: str = "Date", value_col: str = "Rate", series_id: str = "series") -> DataFrame:
    """A two-column series from a CSV with a header; rows without a date or a number are dropped."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(F.lit(series_id).alias("series_id"), F.expr(f"try_cast(`{date_col}` as date)").alias("month"), F.expr(f"try_cast(`{value_col}` as double)").alias("value"))
    return rows.dropna(subset=["month", "value"])


def cadence(series: DataFrame) -> DataFrame:
    """(series_id, median_gap, too_frequent): days between rows; under 25 the series isn't monthly."""
    w = Window.partitionBy("series_id").orderBy("month")
    gaps = series.withColumn("gap", F.datediff("month", F.lag("month").over(w)))
    return gaps.groupBy("series_id").agg(F.median("gap").alias("median_gap")).withColumn("too_frequent", F.coalesce(F.col("median_gap") < 25, F.lit(False)))


def from_wide(wide: DataFrame, date_col: str = "date") -> DataFrame:
    """A row for each month and column of a wide panel; nulls stay."""
    ids = [c for c in wide.columns if c != date_col]
    return wide.unpivot([F.to_date(date_col).alias("month")], ids, "series_id", "value").select("series_id", "month", F.col("value").cast("double").alias("value"))


def to_wide(series: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """A row a month and a column for each of `ids`."""
    return series.groupBy("month").pivot("series_id", ids).agg(F.first(value))


def load_panel(spark: SparkSession, panel_path: str, meta_path: str, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """A wide CSV panel as rows, and its metadata CSV with defaults filled in."""
    wide = spark.read.option("header", True).csv(panel_path)
    wide = wide.select(date_col, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in wide.columns if c != date_col])
    return from_wide(wide, date_col), with_meta_defaults(spark.read.option("header", True).csv(meta_path))


def with_meta_defaults(meta: DataFrame) -> DataFrame:
    """Metadata (id, ...) with group, kind, unit, pub_lag and name filled in where they are missing or null."""
    for c, v in META_DEFAULTS.items():
        meta = meta.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in meta.columns else F.lit(v))
    meta = meta.withColumn("pub_lag", F.coalesce(F.col("pub_lag").cast("int"), F.lit(0)) if "pub_lag" in meta.columns else F.lit(0))
    return meta.withColumn("name", F.coalesce("name", "id") if "name" in meta.columns else F.col("id"))


def monthly(raw: DataFrame, ts: str, value, keys: list[Column], how: str = "mean") -> DataFrame:
    """Monthly means or last values of finer rows, a series for each combination of keys. The last month of a series is dropped if it has under 15 rows while
    its rows are under 5 days apart in the median: it isn't over yet."""
    v = F.col(value) if isinstance(value, str) else value
    rows = raw.select(F.concat_ws("/", *[k.cast("string") for k in keys]).alias("series_id"), F.col(ts).alias("ts"), v.cast("double").alias("v")).where("v is not null and ts is not null")
    agg = F.avg("v") if how == "mean" else F.max_by("v", "ts")
    months = rows.groupBy("series_id", month_of("ts").alias("month")).agg(agg.alias("value"), F.count("*").alias("n"))
    day = rows.select("series_id", F.to_date("ts").alias("day")).distinct()
    gap = day.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("series_id").orderBy("day")))).groupBy("series_id").agg(F.median("gap").alias("gap"))
    last = F.max("month").over(Window.partitionBy("series_id"))
    return months.withColumn("last", last).join(gap, "series_id", "left").where(~((F.col("month") == F.col("last")) & (F.col("n") < 15) & F.coalesce(F.col("gap") < 5, F.lit(False)))).select("series_id", "month", "value")


def monthly_values(raw: DataFrame, date_col: str, value_col: str, series_id: str) -> DataFrame:
    """A series that is monthly already: dates to the first of their month, values that aren't numbers dropped; nothing is merged."""
    rows = raw.select(F.lit(series_id).alias("series_id"), month_of(F.expr(f"try_cast(`{date_col}` as date)")).alias("month"), F.expr(f"try_cast(`{value_col}` as double)").alias("value"))
    return rows.dropna(subset=["month", "value"])


def build_panel(parts: list[DataFrame], first: str = "1947-01-01", last: str | None = None) -> DataFrame:
    """Series aligned on months: in long form that is a union, bounded by a first and a last month."""
    out = parts[0].select("series_id", "month", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("series_id", "month", "value"))
    out = out.where(F.col("month") >= F.lit(first).cast("date"))
    return out.where(F.col("month") <= F.lit(last).cast("date")) if last else out


def extended(base: DataFrame, more: DataFrame, digits: int = 2) -> DataFrame:
    """`base` with rows of `more` after each series' last month, rounded."""
    end = base.where("value is not null").groupBy("series_id").agg(F.max("month").alias("end"))
    later = more.join(end, "series_id").where("month > end").select("series_id", "month", F.round("value", digits).alias("value"))
    return base.select("series_id", "month", "value").unionByName(later)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, months, max_gap, mean_gap) of the months that both have."""
    both = a.select("series_id", "month", F.col("value").alias("x")).join(b.select("series_id", "month", F.col("value").alias("y")), ["series_id", "month"])
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("series_id").agg(F.count("*").alias("months"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))


def last_full_month(days: DataFrame, ts: str = "ts") -> DataFrame:
    """(last_day, last_month): the month of the last day, or the one before unless that day is its month's last business day."""
    d = days.agg(F.max(F.to_date(ts)).alias("last_day"))
    end = F.last_day("last_day")
    business = F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))
    month = F.trunc("last_day", "MM")
    return d.select("last_day", F.when(F.col("last_day") >= business, month).otherwise(F.add_months(month, -1)).alias("last_month"))


def composite(parts: DataFrame, weights: dict[str, float], fallback: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(month, value): 100 exp of the weighted sum of logs of each part over its first value; null in months that lack a part. `fallback` names, for a part, another
    series and the number it is divided by, for months that the part lacks."""
    ids = sorted({*weights, *(x for x, _ in (fallback or {}).values())})
    wide = parts.groupBy("month").pivot("series_id", ids).agg(F.avg("value"))
    for k, (other, by) in (fallback or {}).items():
        wide = wide.withColumn(k, F.coalesce(F.col(k), F.col(other) / by))
    firsts = wide.agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("month"))).alias(f"first_{k}") for k in weights])
    total = None
    for k, w in weights.items():
        term = F.lit(w) * F.ln(F.col(k) / F.col(f"first_{k}"))
        total = term if total is None else total + term
    return wide.crossJoin(F.broadcast(firsts)).select("month", (100 * F.exp(total)).alias("value"))  # firsts has one row


def summary(series: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """First and last month and number of values of each series, with its metadata."""
    out = series.where("value is not null").groupBy("series_id").agg(F.min("month").alias("start"), F.max("month").alias("end"), F.count("*").alias("n"))
    return out if meta is None else out.join(meta, out["series_id"] == meta["id"], "left").drop("id")


def with_user_series(panel: DataFrame, user: DataFrame, meta: DataFrame, user_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel and metadata with a user's series, its months aligned to the panel's; its metadata replaces rows of the same id."""
    months = panel.select("month").distinct()
    ids = user.select("series_id").distinct()
    rows = user.select("series_id", month_of("month").alias("month"), "value")
    aligned = months.crossJoin(F.broadcast(ids)).join(rows, ["series_id", "month"], "left").select("series_id", "month", "value")  # a user's few ids
    mine = with_meta_defaults(user_meta)
    return panel.select("series_id", "month", "value").unionByName(aligned), with_meta_defaults(meta).join(mine.select("id"), "id", "left_anti").unionByName(mine, allowMissingColumns=True)


def spine(series: DataFrame) -> DataFrame:
    """Every month from a series' first to its last, missing values as nulls."""
    ends = series.groupBy("series_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = ends.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(series.select("series_id", "month", "value"), ["series_id", "month"], "left")


def numbered(series: DataFrame) -> DataFrame:
    """Adds t, from 0, over the rows that have a value; the others go."""
    w = Window.partitionBy("series_id").orderBy("month")
    return series.where("value is not null").withColumn("t", (F.row_number().over(w) - 1).cast("int"))


def write_labels(labels: DataFrame, methods: list[str], path: str) -> None:
    """A CSV with a column for each method."""
    labels.groupBy("series_id", "month").pivot("method", methods).agg(F.first("label")).orderBy("series_id", "month").write.mode("overwrite").option("header", True).csv(path)


def write_segments(segments: DataFrame, path: str) -> None:
    segments.drop("imp").orderBy("series_id", "method", "start").write.mode("overwrite").option("header", True).csv(path)


def write_panel(panel: DataFrame, meta: DataFrame, path: str, ids: list[str]) -> None:
    """The series `ids` as a wide CSV, a row a month and 6 digits, under `path`/monthly, and under `path`/meta their metadata with first and last month and number of values."""
    wide = panel.where(F.col("series_id").isin(*ids)).groupBy(F.col("month").alias("date")).pivot("series_id", ids).agg(F.round(F.first("value"), 6))
    wide.orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/monthly")  # a row a month
    rows = meta.where(F.col("id").isin(*ids)).join(summary(panel).withColumnRenamed("series_id", "id"), "id", "left")
    rows = rows.withColumns({"start": F.date_format("start", "yyyy-MM"), "end": F.date_format("end", "yyyy-MM"), "n": F.coalesce("n", F.lit(0))})
    rows.orderBy("id").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/meta")  # a row a series


def write_comparison(rows: DataFrame, path: str) -> None:
    """The table of a matched test as one CSV with a header, a row for each variable, model and horizon."""
    rows.orderBy("var", "model", "h").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shown(value: Column, digits: int = 2, sign: bool = False) -> Column:
    """A number as text: a true minus, a plus if `sign`, no sign at zero, a dash where it is missing or not a number."""
    rounded = F.bround(value, digits)
    body = F.format_string(f"%.{digits}f", F.abs(rounded))
    mark = F.when(rounded < 0, F.lit("\u2212")).when((rounded > 0) & F.lit(sign), F.lit("+")).otherwise(F.lit(""))
    return F.when(value.isNull() | F.isnan(value), F.lit("\u2013")).otherwise(F.concat(mark, body))


def page_data(series: DataFrame) -> str:
    """One series as the JSON of a page: {"dates": [..], "y": [..]}, 6 digits. As long as the series."""
    rows = series.where("value is not null").groupBy().agg(F.array_sort(F.collect_list(F.struct("month", F.round("value", 6).alias("y")))).alias("r"))
    return rows.select(F.to_json(F.struct(F.transform("r", lambda x: F.date_format(x["month"], "yyyy-MM-dd")).alias("dates"), F.transform("r", lambda x: x["y"]).alias("y")))).first()[0]


def as_json(study: DataFrame) -> DataFrame:
    """(json): rows with numbers that aren't finite as nulls, others to 5 places, months as yyyy-MM."""
    cols = []
    for name, kind in study.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.bround(c, 5))
        elif kind in ("date", "timestamp"):
            c = F.date_format(c, "yyyy-MM")
        cols.append(c.alias(name))
    return study.select(F.to_json(F.struct(*cols)).alias("json"))


def page(template: str, title: str, values: dict[str, str]) -> str:
    """An HTML page from a template with {{name}} places."""
    for k, v in {"title": title, **values}.items():
        template = template.replace("{{" + k + "}}", v)
    return template


def zigzag(spark: SparkSession) -> DataFrame:
    """The test fixture: down 2 in 8 months, up 1 in 3, down 3 in 10, then flat."""
    i = F.col("id")
    y = F.when(i <= 8, 5 - 2 * i / 8).when(i <= 11, 3 + (i - 8) / 3).when(i <= 21, 4 - 3 * (i - 11) / 10).otherwise(1 + 0.1 * F.sin((i - 22).cast("double")))
    return spark.range(30).select(F.lit("zigzag").alias("series_id"), F.add_months(F.lit("2000-01-01").cast("date"), i.cast("int")).alias("month"), y.cast("double").alias("value"), i.cast("int").alias("t"))


# ---- series of the driver's tables


def before_last(months: DataFrame) -> DataFrame:
    """The rows before the last month that any series has: that month may be partial."""
    return months.crossJoin(F.broadcast(months.agg(F.max("month").alias("last")))).where("month < last").drop("last")  # one row


def price_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean extended price, in 10,000s, by month of shipment and return flag, without the last, partial month."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    months = li.groupBy(F.col("l_returnflag").alias("series_id"), month_of("l_shipdate").alias("month")).agg(F.round(F.avg("l_extendedprice") / 1e4, 6).alias("value"))
    return before_last(months)


def price_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean total price, in 100,000s, by month of order and order priority, on a spine, without the last month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    months = o.groupBy(F.col("o_orderpriority").alias("series_id"), month_of("o_orderdate").alias("month")).agg(F.round(F.avg("o_totalprice") / 1e5, 6).alias("value"))
    return spine(before_last(months))


def price_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of the standardised price_by_flag: behaves like a random walk, so it trends. With t."""
    w = Window.partitionBy("series_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)
    steps = price_by_flag(spark, sf_dir).withColumn("z", z)
    return numbered(steps.withColumn("value", F.round(F.sum("z").over(w.orderBy("month")), 6)).drop("z"))
