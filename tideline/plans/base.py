"""What the queries and their SQL start from: the walk of prices by return flag, its rule volatility, and method C on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import rule as R
from tideline.operators import labelers as L
from tideline.sources import series as S

FIXED = {"setting_id": "fixed1", "thr": 1.0}
SCALED = {"setting_id": "scaled", "thr": 0.8, "scaled": True, "z": 1.0, "min_len": 3}
LOW = {"setting_id": "fixed0.5", "thr": 0.5}


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(name: str, spark: SparkSession, sf: str, make) -> DataFrame:
    """make(), persisted once a session and folder: small monthly tables that many queries start from."""
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _kept:
        _kept[key] = make().persist()
    return _kept[key]


def walk(spark: SparkSession, sf: str) -> DataFrame:
    return kept("walk", spark, sf, lambda: S.price_walk(spark, sf))


def grid(spark: SparkSession, *rows) -> DataFrame:
    return R.settings(spark, *(rows or (FIXED, SCALED)))


def c_labels(spark: SparkSession, sf: str, *rows) -> DataFrame:
    return L.method_c(walk(spark, sf), grid(spark, *(rows or (FIXED, LOW))))


def c_one(spark: SparkSession, sf: str) -> DataFrame:
    """Method C at a fixed threshold of 1, with value and month: (series_id, t, month, value, label)."""
    return c_labels(spark, sf, FIXED).select("series_id", "t", "label").join(walk(spark, sf), ["series_id", "t"])


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Soft forecasts made of the walk: (series_id, t, p_down, p_side, p_up, truth, value); truth is c_one's label."""
    rows = c_one(spark, sf)
    up = F.round(1 / (1 + F.exp(-(F.col("value") - F.lag("value", 3).over(L.W.by_t())))), 4)
    rows = rows.withColumn("u", F.coalesce(up, F.lit(0.5))).withColumn("truth", F.col("label"))
    return rows.select("series_id", "t", F.round((1 - F.col("u")) * 0.7, 6).alias("p_down"), F.lit(0.3).alias("p_side"), F.round(F.col("u") * 0.7, 6).alias("p_up"), "truth", "value")




def rnd(c, digits: int = 0):
    """Rounds as DuckDB does, by scaling; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * float(10**digits)) / float(10**digits) + 0.0


SQL_FLAG = """
flag0 as (select l_returnflag as series_id, date_trunc('month', l_shipdate)::date as month, round(avg(l_extendedprice) / 1e4::double, 6) as value from lineitem group by 1, 2),
flag as (select * from flag0 where month < (select max(month) from flag0))"""
SQL_WALK = SQL_FLAG + """,
zs as (select series_id, month, (value - avg(value) over (partition by series_id)) / stddev_samp(value) over (partition by series_id) as z from flag),
walk as (select series_id, month, round(sum(z) over (partition by series_id order by month), 6) + 0::double as value, (row_number() over (partition by series_id order by month) - 1)::int as t from zs)"""
SQL_SIG = SQL_WALK + """,
dys as (select *, value - lag(value) over (partition by series_id order by t) as dy from walk),
sigs as (
  select *, case when count(dy) over w >= 24 then stddev_samp(dy) over w else stddev_samp(dy) filter (where t between 1 and 24) over (partition by series_id) end as sig,
    stddev_samp(dy) over (partition by series_id) as sig_full
  from dys window w as (partition by series_id order by t rows between 35 preceding and current row))"""


def sql_c(*rows: dict) -> str:
    """Method C for settings, as the CTE c (series_id, setting_id, t, month, value, label)."""
    values = ", ".join(f"('{r['setting_id']}', {r['thr']}::double, {str(r.get('scaled', False)).lower()}, {r.get('z', 2.0)}::double, {r.get('min_len', 0)}, {r.get('cap', 12)})" for r in rows)
    return SQL_SIG + f""",
setting as (select * from (values {values}) as v(setting_id, thr, scaled, z, min_len, cap)),
slopes as (select *, case when count(value) over w >= 12 then regr_slope(value, t) over w end as slope from sigs window w as (partition by series_id order by t rows between 11 preceding and current row)),
raws as (
  select series_id, setting_id, t, month, value, min_len, case when slope is null then 0 when slope * 11 >= need then 1 when slope * 11 <= -need then -1 else 0 end as raw
  from (select *, case when scaled then greatest(thr, z * sig * sqrt(least(11, cap)::double)) else thr end as need from slopes cross join setting)),
news as (select *, case when raw is not distinct from lag(raw) over (partition by series_id, setting_id order by t) then 0 else 1 end as new from raws),
runs0 as (select *, sum(new) over (partition by series_id, setting_id order by t) as run from news),
kepts as (select *, case when run = 1 or count(*) over (partition by series_id, setting_id, run) >= greatest(3, min_len) then raw end as kept from runs0),
c as (select series_id, setting_id, t, month, value, last_value(kept ignore nulls) over (partition by series_id, setting_id order by t)::int as label from kepts)"""


SQL_C1 = sql_c(FIXED) + """,
c1 as (select series_id, t, month, value, label from c),
crun0 as (select *, case when label is not distinct from lag(label) over (partition by series_id order by t) then 0 else 1 end as new from c1),
crun as (select series_id, t, month, value, label, (sum(new) over (partition by series_id order by t) - 1)::int as run_no from crun0)"""
SQL_FC = SQL_C1 + """,
us as (select *, coalesce(round(1 / (1 + exp(-(value - lag(value, 3) over (partition by series_id order by t)))), 4), 0.5::double) as u from c1),
fc as (select series_id, t, round((1 - u) * 0.7::double, 6) as p_down, 0.3::double as p_side, round(u * 0.7::double, 6) as p_up, label as truth, value from us),
called as (
  select *, case when p_down >= p_side + 1e-9::double and p_down >= p_up then -1 when p_side + 1e-9::double >= p_up then 0 else 1 end as call from fc)"""
