"""Queries on sources, alignment, windows and panels, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import rule as R
from tideline.functions import windows as W
from tideline.operators import labelers as L
from tideline.operators import panel as P
from tideline.plans import machine_sql as MS
from tideline.plans.base import FIXED, SCALED, SQL_C1, SQL_FLAG, SQL_SIG, SQL_WALK, c_one, grid, rnd, walk
from tideline.sources import series as S

Q: dict = {}
SQL: dict[str, str] = {}
META = [("1-URGENT", "front", "rate", 0), ("2-HIGH", "front", "price", 1), ("3-MEDIUM", "policy", "yoy", 1), ("4-NOT SPECIFIED", "labor", "rate", 2), ("5-LOW", "context", "price", 0)]
SQL_META = "meta as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in META) + ') as v(id, "group", kind, pub_lag))'
SQL_PRIO = """
prio0 as (select o_orderpriority as series_id, date_trunc('month', o_orderdate)::date as month, round(avg(o_totalprice) / 1e5::double, 6) as value from orders group by 1, 2),
prio1 as (select * from prio0 where month < (select max(month) from prio0)),
months as (select series_id, unnest(generate_series(min(month), max(month), interval 1 month))::date as month from prio1 group by 1),
prio as (select m.series_id, m.month, p.value from months m left join prio1 p using (series_id, month)), """ + SQL_META
SQL_LIVE = SQL_PRIO + """,
known as (select p.series_id, p.month, k.value from prio p left join (select series_id, (month + pub_lag * interval 1 month)::date as month, value from prio join meta on id = series_id) k using (series_id, month)),
live as (
  select series_id, month, case when month <= max(case when value is not null then month end) over (partition by series_id) then
    last_value(value ignore nulls) over (partition by series_id order by month rows between 2 preceding and current row) end as value from known)"""
SQL_LEVEL = SQL_LIVE + """,
levels as (
  select series_id, month, case kind when 'yoy' then 100 * (value / nullif(lag(value, 12) over w, 0) - 1) when 'price' then 100 * ln(case when value > 0 then value end) else value end as value
  from live join meta on id = series_id window w as (partition by series_id order by month))"""


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def prio(spark, sf):
    return S.price_by_priority(spark, sf)


def meta(spark):
    return spark.createDataFrame(META, "id string, `group` string, kind string, pub_lag int")


def live(spark, sf):
    return P.realtime(prio(spark, sf), meta(spark))


def levels(spark, sf):
    return P.level(live(spark, sf), meta(spark))


def r6(df, *cols):
    return df.withColumns({c: rnd(c, 6) for c in cols})


def part(df, *cols):
    return df.select(*cols)


def nation_meta(s, d):
    """The nations as metadata with gaps: some have no group, lag or name."""
    n, r = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/region.parquet")
    k = F.col("n_nationkey")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.when(k % 2 == 0, F.col("r_name")).alias("group"), F.when(k % 3 == 0, F.col("n_regionkey")).alias("pub_lag"), F.when(k % 5 > 0, F.concat(F.lit("Nation "), k)).alias("name"))


# ---- sources
query("s03_wide_to_long", f"with {SQL_FLAG}, w as (select month, max(value) filter (where series_id = 'A') as a, max(value) filter (where series_id = 'R') as r from flag group by 1) select 'A' as series_id, month, a as value from w union all select 'R', month, r from w")(lambda s, d: S.from_wide(S.to_wide(S.price_by_flag(s, d), ["A", "R"]).withColumnRenamed("month", "date")))
query("s04_meta_defaults", """select n_name as id, coalesce(case when n_nationkey % 2 = 0 then r_name end, 'user') as "group", 'rate' as kind, '' as unit, coalesce(case when n_nationkey % 3 = 0 then n_regionkey end, 0)::int as pub_lag, coalesce(case when n_nationkey % 5 > 0 then 'Nation ' || n_nationkey end, n_name) as name
from nation join region on n_regionkey = r_regionkey""")(lambda s, d: S.with_meta_defaults(nation_meta(s, d)).select("id", "group", "kind", "unit", "pub_lag", "name"))
_DAILY = """
e as (select event_type as series_id, ts, value as v from events where value is not null),
g as (select series_id, median(gap) as gap from (select series_id, day, day - lag(day) over (partition by series_id order by day) as gap from (select distinct series_id, ts::date as day from e)) group by 1),
m as (select series_id, date_trunc('month', ts)::date as month, {agg} as value, count(*) as n from e group by 1, 2)
select m.series_id, month, {out} as value from (select *, max(month) over (partition by series_id) as last from m) m join g using (series_id) where not (month = last and n < 15 and coalesce(gap < 5, false))"""
query("s06_daily_to_monthly_mean", "with " + _DAILY.format(agg="avg(v)", out="round(value, 6)"))(lambda s, d: r6(S.monthly(s.read.parquet(f"{d}/events.parquet"), "ts", "value", [F.col("event_type")]), "value"))
query("s06_daily_to_monthly_last", "with " + _DAILY.format(agg="arg_max(v, ts)", out="round(value, 6)"))(lambda s, d: r6(S.monthly(s.read.parquet(f"{d}/events.parquet").groupBy("event_type", "ts").agg(F.max("value").alias("value")), "ts", "value", [F.col("event_type")], "last"), "value"))
SQL["s06_daily_to_monthly_last"] = SQL["s06_daily_to_monthly_last"].replace("select event_type as series_id, ts, value as v from events where value is not null", "select event_type as series_id, ts, max(value) as v from events group by 1, 2 having max(value) is not null")
query("s08_panel_union", f"with {SQL_FLAG}, {SQL_PRIO} select * from (select * from flag union all select * from prio) where month between date '1996-01-01' and date '2000-12-01'")(lambda s, d: S.build_panel([S.price_by_flag(s, d), prio(s, d)], "1996-01-01", "2000-12-01"))
query("s09_series_extension", f"with {SQL_FLAG}, b as (select * from flag where month < date '1998-01-01') select * from b union all select series_id, month, round(value, 2) from flag where month > (select max(month) from b)")(lambda s, d: S.extended(S.price_by_flag(s, d).where("month < date'1998-01-01'"), S.price_by_flag(s, d)))
query("s10_overlap", f"with {SQL_FLAG} select a.series_id, count(*) as months, round(max(abs(a.value - b.value)), 6) as max_gap, round(avg(abs(a.value - b.value)), 6) as mean_gap from flag a join (select 'A' as series_id, month, value from flag where series_id = 'R' union all select 'R', month, value from flag where series_id = 'N') b using (series_id, month) group by 1")(lambda s, d: r6(S.overlap(S.price_by_flag(s, d), S.price_by_flag(s, d).where("series_id <> 'A'").withColumn("series_id", F.when(F.col("series_id") == "R", "A").otherwise("R"))), "max_gap", "mean_gap"))
query("s11_last_full_month", "select d as last_day, case when d >= (e - greatest(isodow(e)::int - 5, 0)::int) then date_trunc('month', d)::date else (date_trunc('month', d) - interval 1 month)::date end as last_month from (select d, last_day(d) as e from (select max(ts::date) as d from events))")(lambda s, d: S.last_full_month(s.read.parquet(f"{d}/events.parquet")))
query("s12_composite_index", f"with {SQL_FLAG}, w as (select month, max(value) filter (where series_id = 'A') as a, coalesce(max(value) filter (where series_id = 'N' and month < date '1999-01-01'), max(value) filter (where series_id = 'R') / 1.95583::double) as n from flag group by 1), f as (select arg_min(a, month) filter (where a is not null) as fa, arg_min(n, month) filter (where n is not null) as fn from w) select month, round(100 * exp(0.6::double * ln(a / fa) + 0.4::double * ln(n / fn)), 6) as value from w cross join f")(lambda s, d: r6(S.composite(S.price_by_flag(s, d).where("series_id <> 'N' or month < date'1999-01-01'"), {"A": 0.6, "N": 0.4}, {"N": ("R", 1.95583)}), "value"))
query("s13_series_summary", f'with {SQL_PRIO} select series_id, min(month) as start, max(month) as "end", count(*) as n, any_value(kind) as kind from prio join meta on id = series_id where value is not null group by 1')(lambda s, d: S.summary(prio(s, d), meta(s)).select("series_id", "start", "end", "n", "kind"))
query("s14_user_series", f"with {SQL_PRIO}, {SQL_FLAG} select series_id, month, value from prio union all select 'mine', m.month, f.value from (select distinct month from prio) m left join (select * from flag where series_id = 'A' and month > date '1997-01-01') f using (month)")(lambda s, d: S.with_user_series(prio(s, d), S.price_by_flag(s, d).where("series_id = 'A' and month > date'1997-01-01'").withColumn("series_id", F.lit("mine")), meta(s), s.createDataFrame([("mine", 0)], "id string, pub_lag int"))[0])
query("s20_zigzag", f"""with {SQL_FLAG}, n as (select *, row_number() over (partition by series_id order by month) - 1 as i from flag)
select series_id, month, round(value + case when i <= 8 then 5 - 2 * i / 8.0 when i <= 11 then 3 + (i - 8) / 3.0::double when i <= 21 then 4 - 3 * (i - 11) / 10.0 else 1 + 0.1 * sin(i - 22) end, 6)::double as value, i::int as t from n where i < 30""")(
    lambda s, d: r6(S.numbered(S.price_by_flag(s, d)).join(S.zigzag(s).select("t", F.col("value").alias("z")), "t").select("series_id", "month", (F.col("value") + F.col("z")).alias("value"), "t"), "value"))
query("series_s3_by_nation", "with a as (select n_name as series_id, date_trunc('month', l_shipdate)::date as month, round(avg(l_extendedprice) / 1e4::double, 6) as value from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2) select series_id, month, value, (row_number() over (partition by series_id order by month) - 1)::int as t from a")(lambda s, d: S.numbered(s.read.parquet(f"{d}/lineitem.parquet").join(s.read.parquet(f"{d}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey")).join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("series_id"), S.month_of("l_shipdate").alias("month")).agg(rnd(F.avg("l_extendedprice") / 1e4, 6).alias("value"))))
query("s02_cadence", f"with {SQL_FLAG} select series_id, median(gap) as median_gap, median(gap) < 25 as too_frequent from (select series_id, month - lag(month) over (partition by series_id order by month) as gap from flag) group by 1")(lambda s, d: S.cadence(S.price_by_flag(s, d)))
query("series_s5_walk", f"with {SQL_WALK} select * from walk")(walk)
query("spine_with_gaps", f"with {SQL_PRIO} select * from prio")(prio)

# ---- projections, filters
query("p03_information_set", f"with {SQL_LIVE} select * from live where month <= date '1999-06-01'")(lambda s, d: P.info_set(live(s, d), "1999-06-01"))
query("p04_date_range", f"with {SQL_WALK} select series_id, month, value from walk where month between date '1997-03-01' and date '1998-03-01'")(lambda s, d: walk(s, d).where(F.col("month").between("1997-03-01", "1998-03-01")).select("series_id", "month", "value"))
query("p05_complete_rows", f"with {SQL_WALK} select series_id, t, d12 from (select series_id, t, round(value - lag(value, 12) over (partition by series_id order by t), 6) as d12 from walk) where d12 is not null")(lambda s, d: walk(s, d).select("series_id", "t", rnd(W.diff("value", 12), 6).alias("d12")).dropna())
query("p08_first_valid", f"with {SQL_LIVE} select series_id, min(month) as first_month from live where value is not null group by 1")(lambda s, d: P.first_valid(live(s, d)))
query("p09_groups", f"with {SQL_PRIO} select \"group\", array_to_string(list_sort(list(id)), ',') as ids from meta where \"group\" not in ('target', 'context') group by 1")(lambda s, d: P.groups(meta(s), prio(s, d)).select("group", F.array_join("ids", ",").alias("ids")))

# ---- joins
query("j03_inner_on_month", f"with {SQL_FLAG} select a.month, a.value as x, b.value as y from flag a join flag b on a.month = b.month and a.series_id = 'A' and b.series_id = 'R'")(lambda s, d: S.price_by_flag(s, d).where("series_id = 'A'").select("month", F.col("value").alias("x")).join(S.price_by_flag(s, d).where("series_id = 'R'").select("month", F.col("value").alias("y")), "month"))
query("j02_full_outer_on_month", f"with {SQL_FLAG}, {SQL_PRIO} select coalesce(a.month, b.month) as month, a.value as x, b.value as y from (select * from flag where series_id = 'A' and month > date '1996-05-01') a full join (select * from prio where series_id = '2-HIGH') b on a.month = b.month")(lambda s, d: S.price_by_flag(s, d).where("series_id = 'A' and month > date'1996-05-01'").select("month", F.col("value").alias("x")).join(prio(s, d).where("series_id = '2-HIGH'").select("month", F.col("value").alias("y")), "month", "full"))
query("j06_known_at", f"with {SQL_LIVE} select * from known")(lambda s, d: P.known_at(prio(s, d), meta(s)))
query("j15_vintages", f"with {SQL_WALK}, e as (select unnest([40, 60, 80]) as v) select series_id || '@' || v as series_id, v::int as vintage, count(*) as n, round(sum(value) + 1e-9::double, 4) as total from walk join e on t <= v group by 1, 2")(lambda s, d: L.vintages(walk(s, d), s.createDataFrame([(40,), (60,), (80,)], "T int")).groupBy("series_id", "vintage").agg(F.count("*").alias("n"), rnd(F.sum("value") + 1e-9, 4).alias("total")))

# ---- aggregations
query("g02_g06_moments", f"with {SQL_SIG} select series_id, round(stddev_samp(dy), 6) as sd, round(var_pop(dy), 6) as vp, round(median(value), 6) as med, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.95), 6) as p95, round(avg(case when dy > 0 then 1.0 else 0 end), 6)::double as share_up from dys group by 1")(lambda s, d: L.with_sigma(walk(s, d)).groupBy("series_id").agg(rnd(F.stddev_samp("dy"), 6).alias("sd"), rnd(F.var_pop("dy"), 6).alias("vp"), rnd(F.median("value"), 6).alias("med"), rnd(F.percentile("value", 0.05), 6).alias("p5"), rnd(F.percentile("value", 0.95), 6).alias("p95"), rnd(F.avg((F.coalesce("dy", F.lit(0.0)) > 0).cast("double")), 6).alias("share_up")))
query("g04_beta", f"with {SQL_SIG} select a.series_id as x, b.series_id as y, case when count(*) > 24 then round(covar_samp(a.dy, b.dy) / var_samp(a.dy), 6) else 0 end as beta from dys a join dys b on a.month = b.month where a.dy is not null and b.dy is not null group by 1, 2")(lambda s, d: (lambda v: v.select(F.col("series_id").alias("x"), "month", F.col("dy").alias("a")).join(v.select(F.col("series_id").alias("y"), "month", F.col("dy").alias("b")), "month").groupBy("x", "y").agg(F.when(F.count("*") > 24, rnd(F.covar_samp("a", "b") / F.var_samp("a"), 6)).otherwise(0.0).alias("beta")))(L.with_sigma(walk(s, d)).where("dy is not null")))
query("g08_best_month", f"with {SQL_WALK} select series_id, arg_max(month, value) as month, max(value) as value from walk group by 1")(lambda s, d: walk(s, d).groupBy("series_id").agg(F.max_by("month", "value").alias("month"), F.max("value").alias("value")))
query("g13_transitions", f"with {SQL_C1} select series_id, prev, label, count(*) + case when prev = label then 21 else 1 end as n from (select series_id, label, lag(label) over (partition by series_id order by t) as prev from c1) where prev is not null group by 1, 2, 3")(lambda s, d: c_one(s, d).withColumn("prev", F.lag("label").over(W.by_t())).where("prev is not null").groupBy("series_id", "prev", "label").agg((F.count("*") + F.when(F.first("prev") == F.first("label"), 21).otherwise(1)).alias("n")))

# ---- windows
query("w01_w02_lags", f"with {SQL_WALK} select series_id, t, lag(value, 1) over w as l1, lag(value, 6) over w as l6, round(value - lag(value, 3) over w, 6) as d3 from walk window w as (partition by series_id order by t)")(lambda s, d: walk(s, d).select("series_id", "t", W.lag("value").alias("l1"), W.lag("value", 6).alias("l6"), rnd(W.diff("value", 3), 6).alias("d3")))
_ROLL = "case when count(value) over w >= 12 then {} over w end"
query("w03_w04_rolling", f"with {SQL_WALK} select series_id, t, {_ROLL.format('max(value)')} as hi, {_ROLL.format('min(value)')} as lo, round({_ROLL.format('avg(value)')} + 1e-9::double, 6) as mean, round({_ROLL.format('stddev_samp(value)')}, 6) as sd from walk window w as (partition by series_id order by t rows between 11 preceding and current row)")(lambda s, d: walk(s, d).select("series_id", "t", W.rolling(F.max, "value", 12).alias("hi"), W.rolling(F.min, "value", 12).alias("lo"), rnd(W.rolling(F.avg, "value", 12) + 1e-9, 6).alias("mean"), rnd(W.rolling(F.stddev_samp, "value", 12), 6).alias("sd")))
query("w05_lagged_volatility", f"with {SQL_SIG}, v as (select series_id, t, case when count(dy) over w >= 12 then stddev_samp(dy) over w end as v from dys window w as (partition by series_id order by t rows between 35 preceding and current row)) select series_id, t, round(lag(v) over (partition by series_id order by t), 6) as v from v")(lambda s, d: L.with_sigma(walk(s, d)).withColumn("v0", W.rolling(F.stddev_samp, "dy", 36, 12)).select("series_id", "t", rnd(W.lag("v0"), 6).alias("v")))
query("w06_expanding_z", f"with {SQL_WALK} select series_id, t, case when count(value) over w >= 60 then round((value - avg(value) over w) / stddev_samp(value) over w, 6) end as z from walk window w as (partition by series_id order by t)")(lambda s, d: walk(s, d).select("series_id", "t", rnd((F.col("value") - W.expanding(F.avg, "value", 60)) / W.expanding(F.stddev_samp, "value", 60), 6).alias("z")))
query("w07_rule_sigma", f"with {SQL_SIG} select series_id, t, round(sig, 6) as sig, round(sig_full, 6) as sig_full from sigs")(lambda s, d: L.with_sigma(walk(s, d)).withColumn("full", F.stddev_samp("dy").over(Window.partitionBy("series_id"))).select("series_id", "t", rnd("sig", 6).alias("sig"), rnd("full", 6).alias("sig_full")))
query("w08_bounded_fill", f"with {SQL_LIVE} select * from live")(live)
query("w09_rolling_slope", f"with {SQL_WALK} select series_id, t, case when count(value) over w >= 12 then round(regr_slope(value, t) over w + 1e-9::double, 6) end as slope from walk window w as (partition by series_id order by t rows between 11 preceding and current row)")(lambda s, d: walk(s, d).select("series_id", "t", rnd(W.slope("value", "t", 12) + 1e-9, 6).alias("slope")))
query("w10_runs", f"with {SQL_C1} select series_id, run_no, label, min(t) as first, max(t) as last from crun group by 1, 2, 3")(lambda s, d: W.runs(c_one(s, d)))
query("w11_age", f"with {SQL_C1} select series_id, t, label, round(ln(row_number() over (partition by series_id, run_no order by t)), 6) as age from crun")(lambda s, d: W.age(c_one(s, d)).select("series_id", "t", "label", rnd("age", 6).alias("age")))
query("w13_flips", f"with {SQL_C1} select series_id, (sum(new) - 1)::bigint as flips from crun0 group by 1")(lambda s, d: W.run_ids(c_one(s, d)).groupBy("series_id").agg(F.max("run_no").cast("long").alias("flips")))
query("w14_average_rank", f"with {SQL_WALK}, x as (select series_id, t, round(value) + 0::double as v from walk) select series_id, t, v, rank() over (partition by series_id order by v) + (count(*) over (partition by series_id, v) - 1) / 2.0::double as r from x")(lambda s, d: walk(s, d).withColumn("v", rnd("value")).select("series_id", "t", "v", W.average_rank("v", ["series_id"]).alias("r")))
query("w15_cumulative_sums", f"with {SQL_WALK} select series_id, t, (sum(t) over w)::bigint as sx, round(sum(value) over w + 1e-9::double, 5) as sy, round(sum(t * value) over w + 1e-9::double, 4) as sxy, round(sum(value * value) over w + 1e-9::double, 4) as syy from walk window w as (partition by series_id order by t)")(lambda s, d: (lambda w: walk(s, d).select("series_id", "t", F.sum("t").over(w).alias("sx"), rnd(F.sum("value").over(w) + 1e-9, 5).alias("sy"), rnd(F.sum(F.col("t") * F.col("value")).over(w) + 1e-9, 4).alias("sxy"), rnd(F.sum(F.col("value") * F.col("value")).over(w) + 1e-9, 4).alias("syy")))(W.by_t().rowsBetween(Window.unboundedPreceding, 0)))
query("w16_autocovariance", f"with {SQL_SIG}, x as (select series_id, t, dy - avg(dy) over (partition by series_id) as dc from dys where dy is not null), k as (select unnest(range(0, 12)) as k) select a.series_id, k::int as k, round(sum(a.dc * b.dc) / any_value(n.n), 6) as cov from x a cross join k join x b on b.series_id = a.series_id and b.t = a.t - k join (select series_id, count(*) as n from x group by 1) n on n.series_id = a.series_id group by 1, 2")(lambda s, d: (lambda x: x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("tk", F.col("t") - F.col("k")).join(x.select("series_id", F.col("t").alias("tk"), F.col("dc").alias("dk")), ["series_id", "tk"]).groupBy("series_id", "k").agg(rnd(F.sum(F.col("dc") * F.col("dk")) / F.first("n"), 6).alias("cov")))(L.with_sigma(walk(s, d)).where("dy is not null").withColumn("dc", F.col("dy") - F.avg("dy").over(Window.partitionBy("series_id"))).withColumn("n", F.count("*").over(Window.partitionBy("series_id")))))
query("w17_short_runs", f"with {SQL_WALK}, x as (select series_id, t, case when value > lag(value) over (partition by series_id order by t) then 1 else 0 end as label from walk), n as (select *, case when label is not distinct from lag(label) over (partition by series_id order by t) then 0 else 1 end as new from x), r as (select *, sum(new) over (partition by series_id order by t) as run from n), k as (select *, case when run = 1 or count(*) over (partition by series_id, run) >= 3 then label end as kept from r) select series_id, t, last_value(kept ignore nulls) over (partition by series_id order by t) as label from k")(lambda s, d: W.without_short_runs(walk(s, d).withColumn("label", F.coalesce((F.col("value") > W.lag("value")).cast("int"), F.lit(0))), 3).select("series_id", "t", "label"))

# ---- panel
query("f02_level", f"with {SQL_LEVEL} select series_id, month, round(value, 6) as value from levels")(lambda s, d: r6(levels(s, d), "value"))
query("f05_causal_sigma", f"with {SQL_SIG} select series_id, t, round(case when t between 1 and 24 then case when count(dy) over w >= 6 then stddev_samp(dy) over w end else sig end, 6) as sig from sigs window w as (partition by series_id order by t)")(lambda s, d: P.causal_sigma(walk(s, d)).select("series_id", "t", rnd("sig", 6).alias("sig")))
def live_d(s, d):
    """Real-time labels of method D, as the target's features have them whatever its own labels are."""
    return L.machine_labels(walk(s, d), grid(s, FIXED), ("D_rt",)).select("series_id", "t", "label")


_OWN = f"recursive {MS.walk_source()}, {MS.config(FIXED)}, {MS.machine(True)}" + """,
crun0 as (select w.series_id, w.t, w.value, m.state as label, case when m.state is not distinct from lag(m.state) over (partition by w.series_id order by w.t) then 0 else 1 end as new from walk w join m using (series_id, t)),
crun as (select *, sum(new) over (partition by series_id order by t) as run_no from crun0),
dyw as (select *, value - lag(value) over (partition by series_id order by t) as dy from crun),
own as (
  select series_id, t, 100 * (value - lag(value, 1) over w) as d1, 100 * (value - lag(value, 3) over w) as d3, 100 * (value - lag(value, 6) over w) as d6, 100 * (value - lag(value, 12) over w) as d12,
    case when count(value) over w12 >= 12 then 100 * (value - max(value) over w12) end as dd12, case when count(value) over w12 >= 12 then 100 * (value - min(value) over w12) end as ru12,
    case when count(value) over w12 >= 12 then 100 * (value - avg(value) over w12) end as gap12, case when count(dy) over w12 >= 12 then 100 * stddev_samp(dy) over w12 end as vol12,
    case when count(dy) over w36 >= 12 then 100 * stddev_samp(dy) over w36 end as vol36,
    (label = 1)::int::double as rt_up, (label = -1)::int::double as rt_down, ln(row_number() over (partition by series_id, run_no order by t)) as rt_age
  from dyw window w as (partition by series_id order by t), w12 as (partition by series_id order by t rows between 11 preceding and current row), w36 as (partition by series_id order by t rows between 35 preceding and current row))"""
_OWNC = ["d1", "d3", "d6", "d12", "dd12", "ru12", "gap12", "vol12", "z3", "z12", "ddz", "ruz", "rt_up", "rt_down", "rt_age"]
query("f03_own_features", f"with {_OWN}, o2 as (select *, d3 / nullif(vol36 * sqrt(3), 0) as z3, d12 / nullif(vol36 * sqrt(12), 0) as z12, dd12 / nullif(vol36, 0) as ddz, ru12 / nullif(vol36, 0) as ruz from own) select series_id, t, " + ", ".join(f"round({c} + 1e-9::double, 5) as {c}" for c in _OWNC) + " from o2")(lambda s, d: P.own_features(walk(s, d), live_d(s, d)).select("series_id", "t", *[rnd(F.col(c) + 1e-9, 5).alias(c) for c in _OWNC]))
_X = ["d1", "d12", "z3", "z12", "lvl", "spr", "spr_d12"]
query("f04_x_features", f"with {SQL_LEVEL}, {SQL_FLAG}, j as (select l.series_id, l.month, l.value, case when l.series_id = '2-HIGH' then f.value - l.value end as spr, l.value - lag(l.value) over (partition by l.series_id order by l.month) as dx from levels l left join (select month, value from flag where series_id = 'A') f using (month)), k as (select *, case when count(dx) over w36 >= 12 then stddev_samp(dx) over w36 end as sd, value - lag(value, 3) over w as d3, value - lag(value, 12) over w as d12, spr - lag(spr, 12) over w as spr_d12 from j window w as (partition by series_id order by month), w36 as (partition by series_id order by month rows between 35 preceding and current row)) select series_id, month, round(dx, 5) as d1, round(d12, 5) as d12, round(d3 / nullif(sd * sqrt(3), 0), 5) as z3, round(d12 / nullif(sd * sqrt(12), 0), 5) as z12, round(case when series_id = '1-URGENT' then value end, 5) as lvl, round(spr, 5) as spr, round(spr_d12, 5) as spr_d12 from k")(lambda s, d: P.x_features(levels(s, d), S.price_by_flag(s, d).where("series_id = 'A'"), None, ("1-URGENT",), ("2-HIGH",)).select("series_id", "month", *[rnd(c, 5).alias(c) for c in _X]))
_STATE = f"""recursive {SQL_LEVEL}, own as (select series_id, month, value, row_number() over (partition by series_id order by month) - 1 as t, count(*) over (partition by series_id) as n from levels where value is not null),
{MS.source("select series_id, t, value from own where n > 14", True).replace("src as (", "src2 as (")},
src as (select series_id, t, value, coalesce(sig, max(sig) filter (where t <= 12) over (partition by series_id), 1) as sig from src2),
{MS.config({"setting_id": "x", "thr": 0.0, "scaled": True, "z": 2.0, "min_len": 3})}, {MS.machine(True)},
states as (select own.series_id, own.month, case when own.t >= 12 then m.state end::int as label from own left join m using (series_id, t))"""
query("f06_trend_state", f"with {_STATE} select * from states")(lambda s, d: P.trend_state(levels(s, d)))
_XS = f"""{_STATE},
j as (select series_id, month, value, value - lag(value) over (partition by series_id order by month) as dx from levels),
x as (select *, case when count(dx) over w36 >= 12 then stddev_samp(dx) over w36 end as sd, value - lag(value, 3) over w as d3, value - lag(value, 12) over w as d12 from j window w as (partition by series_id order by month), w36 as (partition by series_id order by month rows between 35 preceding and current row)),
xs as (select x.series_id, x.month, round(d3 / nullif(sd * sqrt(3), 0), 5) as z3, round(d12 / nullif(sd * sqrt(12), 0), 5) as z12, (label = 1)::int::double as up, (label = -1)::int::double as down from x left join states using (series_id, month))"""
_WIDE = ", ".join(f"{c}.{k} as \"{n}_{k}\"" for c, n in (("u", "1-URGENT"), ("h", "2-HIGH")) for k in ("z3", "z12", "up", "down"))


def compacted(s, d):
    """The few columns that short samples bear, of two variables beside the months of one target."""
    x = P.x_features(levels(s, d), S.price_by_flag(s, d).where("series_id = 'A'"), P.trend_state(levels(s, d)))
    wide = P.compact(P.matrix(P.own_features(walk(s, d).where("series_id = 'A'"), live_d(s, d)).select("month", "t"), x, ["1-URGENT", "2-HIGH"], ["d1", "z3", "z12", "up", "down", "age"]))
    return wide.select(*[rnd(F.col(f"`{c}`"), 5).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in wide.dtypes])


query("p02_compact_features", f"with {_XS}, {SQL_WALK.replace('prio', 'prio')} select w.month, w.t, {_WIDE} from walk w left join xs u on u.month = w.month and u.series_id = '1-URGENT' left join xs h on h.month = w.month and h.series_id = '2-HIGH' where w.series_id = 'A'")(compacted)
query("f08_macro_momentum", f"with {SQL_LEVEL}, g as (select series_id, month, case when series_id = '5-LOW' then -1 else 1 end * (value - lag(value, 12) over (partition by series_id order by month)) as d from levels), z as (select series_id, month, case when count(d) over w >= 24 then (d - avg(d) over w) / nullif(stddev_samp(d) over w, 0) end as z from g window w as (partition by series_id order by month)) select month, case when count(z) >= 3 then round(avg(z), 6) end as value from z group by 1")(lambda s, d: r6(P.macro_momentum(levels(s, d), {k: -1 if k == "5-LOW" else 1 for k, *_ in META}, 24, 3), "value"))

# ---- rule
query("t02_required", f"with {SQL_SIG}, h as (select unnest([1, 6, 12, 24]) as m) select series_id, t, m::int as m, round(greatest(0.8::double, sig * sqrt(least(greatest(m, 1), 12)::double)), 6) as req from sigs cross join h")(lambda s, d: L.with_settings(walk(s, d), grid(s, SCALED)).withColumn("m", F.explode(F.array(*map(F.lit, (1, 6, 12, 24))))).select("series_id", "t", "m", rnd(R.required(F.lit(0), F.col("m"), F.col("sig")), 6).alias("req")))
query("t04_t05_label_and_score", f"with {SQL_SIG}, x as (select a.series_id, b.t as a, a.t as b, a.value - b.value as mv, a.sig, greatest(0.8::double, a.sig * sqrt(least(a.t - b.t, 12)::double)) as need from sigs a join sigs b on a.series_id = b.series_id and b.t = a.t - 6) select series_id, a, b, case when b - a < 3 then 0 when mv >= need - 1e-12::double then 1 when mv <= 1e-12::double - need then -1 else 0 end as label, round(abs(mv) / (sig * sqrt((b - a)::double)), 6) as score from x")(lambda s, d: (lambda v: v.withColumn("a", F.col("t") - 6).withColumn("mv", F.col("value") - F.lag("value", 6).over(W.by_t())).where("mv is not null").select("series_id", "a", F.col("t").alias("b"), R.rule_label(F.col("mv"), F.col("a"), F.col("t"), F.col("sig")).alias("label"), rnd(R.zscore(F.col("mv"), F.col("a"), F.col("t"), F.col("sig")), 6).alias("score")))(L.with_settings(walk(s, d), grid(s, SCALED))))
query("t08_required_table", f"with {SQL_SIG}, l as (select series_id, arg_max(sig, t) as sig from sigs group by 1), h as (select unnest([1, 3, 6, 12, 24]) as months) select series_id, months::int as months, round(100 * greatest(0.8::double, sig * sqrt(least(months, 12)::double)))::bigint as req_bp from l cross join h")(lambda s, d: R.required_table(L.with_settings(walk(s, d), grid(s, SCALED)).withColumn("last", F.max("t").over(Window.partitionBy("series_id"))).where("t = last")).select("series_id", "months", "req_bp"))
query("o03_latest_rows", f"with {SQL_WALK} select series_id, t, value from (select *, row_number() over (partition by series_id order by t desc) as n from walk) where n <= 8")(lambda s, d: walk(s, d).withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("t").desc()))).where("n <= 8").select("series_id", "t", "value"))
query("o06_newest_first", f"with {SQL_WALK} select series_id, (row_number() over (partition by series_id order by month desc))::int as place, month, value from walk")(lambda s, d: walk(s, d).select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("month").desc())).alias("place"), "month", "value").orderBy("series_id", "place"))
query("c04_number_format", f"""with {SQL_WALK}, x as (select series_id, t, round(value - lag(value, 12) over (partition by series_id order by t), 3) as d from walk)
select series_id, t, case when d is null then chr(8211) else case when d < 0 then chr(8722) when d > 0 then '+' else '' end || printf('%.3f', abs(d)) end as shown from x""")(
    lambda s, d: walk(s, d).select("series_id", "t", S.shown(F.round(W.diff("value", 12), 3), 3, True).alias("shown")))
query("s16_json_rows", f"with {SQL_WALK} select '{{\"series_id\":\"' || series_id || '\",\"month\":\"' || strftime(month, '%Y-%m') || '\",\"hundredths\":' || round_even(100 * value, 0)::bigint || ',\"t\":' || t || '}}' as json from walk")(lambda s, d: S.as_json(walk(s, d).select("series_id", "month", F.bround(100 * F.col("value")).cast("long").alias("hundredths"), "t")))

# ---- more joins, aggregates, sets and orders
query("s07_monthly_values", "select 'x' as series_id, date_trunc('month', d::date)::date as month, v::double as value from (values ('2020-01-15', '1.5'), ('2020-02-10', '2.5')) as t(d, v)")(lambda s, d: S.monthly_values(s.createDataFrame([("2020-01-15", "1.5"), ("2020-02-10", "2.5"), ("2020-03-10", "."), ("bad", "1")], "d string, v string"), "d", "v", "x"))
query("j04_coalesce_join", f"with {SQL_FLAG} select coalesce(a.month, b.month) as month, coalesce(a.value, b.value / 1.95583::double) as value from (select * from flag where series_id = 'A' and month >= date '1999-01-01') a full join (select * from flag where series_id = 'R') b using (month)".replace("select coalesce(a.month, b.month) as month", "select month"))(lambda s, d: S.price_by_flag(s, d).where("series_id = 'A' and month >= date'1999-01-01'").select("month", F.col("value").alias("a")).join(S.price_by_flag(s, d).where("series_id = 'R'").select("month", F.col("value").alias("b")), "month", "full").select("month", F.coalesce("a", F.col("b") / 1.95583).alias("value")))
query("j05_metadata_lookup", f"with {SQL_PRIO} select series_id, month, coalesce(pub_lag, 0) as pub_lag, coalesce(kind, 'rate') as kind from prio left join (select * from meta where id <> '5-LOW') on id = series_id")(lambda s, d: prio(s, d).join(F.broadcast(meta(s).where("id <> '5-LOW'")), F.col("series_id") == F.col("id"), "left").select("series_id", "month", F.coalesce("pub_lag", F.lit(0)).alias("pub_lag"), F.coalesce("kind", F.lit("rate")).alias("kind")))
query("j13_paired_months", f"with {SQL_C1} select a.series_id, a.t, a.label as x, b.label as y from c1 a join c1 b on a.t = b.t and a.series_id = 'A' and b.series_id = 'R'")(lambda s, d: c_one(s, d).where("series_id = 'A'").select("series_id", "t", F.col("label").alias("x")).join(c_one(s, d).where("series_id = 'R'").select("t", F.col("label").alias("y")), "t"))
query("j14_membership", f"with {SQL_WALK} select series_id, t, value from walk where series_id in (select series_id from walk group by 1 having max(value) > 3)")(lambda s, d: walk(s, d).select("series_id", "t", "value").join(walk(s, d).groupBy("series_id").agg(F.max("value").alias("m")).where("m > 3").select("series_id"), "series_id", "left_semi"))
query("g01_mean_last_count", f"with {SQL_WALK} select series_id, year(month)::int as year, round(avg(value) + 1e-9::double, 6) as mean, arg_max(value, month) as last, count(*) as n from walk group by 1, 2")(lambda s, d: walk(s, d).groupBy("series_id", F.year("month").alias("year")).agg(rnd(F.avg("value") + 1e-9, 6).alias("mean"), F.max_by("value", "month").alias("last"), F.count("*").alias("n")))
query("g07_g09_shares_and_distinct", f"with {SQL_C1} select series_id, count(distinct label) as classes, round(avg((label = 1)::int), 6) as up, count(*) filter (where label = -1) as n_down from c1 group by 1")(lambda s, d: c_one(s, d).groupBy("series_id").agg(F.countDistinct("label").alias("classes"), rnd(F.avg((F.col("label") == 1).cast("double")), 6).alias("up"), F.count_if(F.col("label") == -1).alias("n_down")))
query("u01_union", f"with {SQL_FLAG}, {SQL_PRIO} select series_id, count(*) as n from (select * from flag union all select * from prio) group by 1")(lambda s, d: S.price_by_flag(s, d).unionByName(prio(s, d)).groupBy("series_id").agg(F.count("*").alias("n")))
query("u02_set_difference", f"with {SQL_FLAG}, {SQL_PRIO} select month from prio except select month from flag where series_id = 'A' and month > date '1998-01-01'")(lambda s, d: prio(s, d).select("month").subtract(S.price_by_flag(s, d).where("series_id = 'A' and month > date'1998-01-01'").select("month")))
query("u03_month_intersection", f"with {SQL_FLAG}, {SQL_PRIO} select month from prio intersect select month from flag where month > date '1999-01-01'")(lambda s, d: prio(s, d).select("month").intersect(S.price_by_flag(s, d).where("month > date'1999-01-01'").select("month")))
query("o02_top_moves", f"with {SQL_SIG} select series_id, t, round(dy, 6) as dy from dys where dy is not null order by abs(dy) desc, series_id, t limit 3")(lambda s, d: L.with_sigma(walk(s, d)).where("dy is not null").orderBy(F.abs("dy").desc(), "series_id", "t").limit(3).select("series_id", "t", rnd("dy", 6).alias("dy")))
query("o05_distinct_breakpoints", f"with {SQL_C1} select series_id, array_to_string(list_sort(list_distinct(list(start))), ',') as breaks from (select series_id, run_no, greatest(min(t) - 1, 0) as start from crun group by 1, 2) group by 1")(lambda s, d: W.runs(c_one(s, d)).groupBy("series_id").agg(F.array_join(F.array_sort(F.collect_set(F.greatest(F.col("first") - 1, F.lit(0)))), ",").alias("breaks")))
