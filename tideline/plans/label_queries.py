"""Queries on labelings and scores, with their SQL where labels are method C's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import filters as FI
from tideline.functions import rule as R
from tideline.functions import tables as T
from tideline.functions import windows as W
from tideline.operators import labelers as L
from tideline.operators import leadlag as LL
from tideline.operators import metrics as M
from tideline.operators import scoring as C
from tideline.plans.base import FIXED, LOW, SCALED, SQL_C1, SQL_FC, SQL_SIG, c_labels, c_one, forecasts, grid, rnd, sql_c, walk
from tideline.plans import machine_sql as MS
from tideline.plans.machine_sql import LIVE_A, LIVE_D

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ["series_id"]


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, digits: int = 6):
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def called(s, d):
    return forecasts(s, d).withColumn("call", M.calls())


def d_segments(s, d):
    return L.machine_segments(walk(s, d), grid(s, FIXED), ("D",))


# ---- labelings
query("m04_method_c", f"with {sql_c(FIXED, LOW)} select series_id, setting_id, 'C' as method, t, label from c")(lambda s, d: c_labels(s, d))
query("m04_method_c_scaled", f"with {sql_c(SCALED)} select series_id, setting_id, 'C' as method, t, label from c")(lambda s, d: L.method_c(walk(s, d), grid(s, SCALED)))
# A run counts from its third month (or its minimum) on: the number within the run instead of the run's length.
_CAUSAL = sql_c(FIXED, SCALED).replace("count(*) over (partition by series_id, setting_id, run) >=", "row_number() over (partition by series_id, setting_id, run order by t) >=")
query("m04_method_c_causal", f"with {_CAUSAL} select series_id, setting_id, 'C_causal' as method, t, label from c")(lambda s, d: L.method_c_causal(walk(s, d), grid(s)))
for _m, _name in (("A", "m01_machine"), ("D", "m05_retracement"), ("B", "m03_piecewise"), ("E", "m07_kalman"), ("F", "m12_l1"), ("G", "m15_swings")):
    _sql = {"A": (MS.segments_sql(False, FIXED, SCALED), MS.labels_sql(False, FIXED, SCALED)), "D": (MS.segments_sql(True, FIXED, SCALED), MS.labels_sql(True, FIXED, SCALED)), "B": (MS.piecewise_sql(FIXED, SCALED), MS.piecewise_sql(FIXED, SCALED, labels=True))}.get(_m, (None, None))
    query(f"{_name}_segments", _sql[0])(lambda s, d, m=_m: L.machine_segments(walk(s, d), grid(s), (m,)))
    query(f"{_name}_labels", _sql[1])(lambda s, d, m=_m: L.machine_labels(walk(s, d), grid(s), (m, f"{m}_rt") if m in "ADEF" else (m,)))
query("m01_live_a", LIVE_A)(lambda s, d: L.machine_labels(walk(s, d), grid(s, FIXED), ("A_rt",)))
query("m05_live_d", LIVE_D)(lambda s, d: L.machine_labels(walk(s, d), grid(s, FIXED), ("D_rt",)))
query("m02_pieces", MS.pieces_sql(FIXED))(lambda s, d: rounded(L.pieces(walk(s, d), grid(s, FIXED))))


def from_table_function(s, d):
    """Segments of A and D by the table function, in SQL."""
    T.register(s)
    L.with_sigma(walk(s, d)).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "value", "sig"))).alias("r")).select("series_id", F.expr("transform(r, x -> x.value)").alias("ys"), F.expr("transform(r, x -> x.sig)").alias("sg")).createOrReplaceTempView("tideline_series")
    return s.sql("select s.series_id, 'fixed1' as setting_id, g.* from tideline_series s, lateral segments(s.ys, s.sg, 'A,D', 1.0D, false, 2.0D, 0) g")


query("d01_segments_table_function", f"select * from ({MS.segments_sql(False, FIXED)}) union all select * from ({MS.segments_sql(True, FIXED)})")(from_table_function)


def filtered(s, d):
    """Chances of states of the walk's changes, month by month, by a model whose parameters are the moments and moves of labelled months; no Python."""
    by = Window.partitionBy("series_id").orderBy("t")
    rows = c_one(s, d).select("series_id", "t", (F.col("label") + 1).alias("s"), F.lag(F.col("label") + 1).over(by).alias("p"), (F.col("value") - F.lag("value").over(by)).alias("z")).where("z is not null")
    of = lambda agg, k: agg(F.when(F.col("s") == k, F.col("z")))
    move = lambda a, b: F.count_if((F.col("t") >= 2) & (F.col("p") == a) & (F.col("s") == b)) + 1
    share = lambda a: F.array(*[move(a, b) / sum((move(a, c) for c in range(3)), F.lit(0)) for b in range(3)])
    model = rows.groupBy("series_id").agg(
        F.array(*[of(F.avg, k) for k in range(3)]).alias("mean"), F.array(*[of(F.var_samp, k) + 1e-4 for k in range(3)]).alias("variance"), F.array(*[(F.count_if((F.col("t") <= 12) & (F.col("s") == k)) + 1) / 15 for k in range(3)]).alias("first"),
        F.array(*[share(a) for a in range(3)]).alias("move"), F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda x: x["z"]).alias("zs"))
    chances = FI.forward(F.col("zs"), F.col("mean"), F.col("variance"), F.col("first"), F.array_repeat("move", F.size("zs")))
    return model.select("series_id", F.posexplode(chances).alias("k", "p")).select("series_id", (F.col("k") + 1).cast("int").alias("t"), *[rnd(F.get("p", k), 6).alias(n) for k, n in enumerate(C.PROBABILITIES)])


query("h20_forward_filter", f"with recursive {SQL_C1}, {MS.FILTER_SQL} select series_id, (k + 1)::int as t, round(now[1], 6) as p_down, round(now[2], 6) as p_side, round(now[3], 6) as p_up from fw")(filtered)
query("m10_l1_levels")(lambda s, d: L.levels(walk(s, d), grid(s, FIXED), "l1"))
query("m13_l1_live_levels")(lambda s, d: L.levels(walk(s, d), grid(s, FIXED), "l1_live"))
query("m16_all_methods")(lambda s, d: L.machine_labels(walk(s, d), grid(s)).unionByName(L.method_c(walk(s, d), grid(s))))
query("fin_end_states", f"with {MS.ex_post(True, FIXED, SCALED)}, {MS.FIN} select * from fin")(lambda s, d: L.end_states(walk(s, d), grid(s)))
query("t09_triggers", MS.triggers_sql(FIXED, SCALED))(lambda s, d: L.triggers(walk(s, d), grid(s), L.end_states(walk(s, d), grid(s))).withColumns({c: rnd(c, 6) for c in ("up_trigger", "down_trigger", "flip_level")}))
# The Kalman filter's gains don't depend on data: level and slope are linear in it, so a recursive CTE can follow.
query("m06_kalman_filter", f"""with recursive {SQL_SIG},
k(series_id, t, l, s, a, b, c) as (
  select series_id, t, value, 0::double, 1e7::double - 1e7::double / (1e7::double + 1) * 1e7::double, 0::double, 1e7::double from walk where t = 0
  union all
  select series_id, t, pl + pa / (pa + 1) * (y - pl), ps + pb / (pa + 1) * (y - pl), pa - pa / (pa + 1) * pa, pb - pa / (pa + 1) * pb, pc - pb / (pa + 1) * pb
  from (select w.series_id, w.t, w.value as y, k.l + k.s as pl, k.s as ps, k.a + 2 * k.b + k.c as pa, k.b + k.c as pb, k.c + 0.001::double as pc from k join walk w on w.series_id = k.series_id and w.t = k.t + 1))
select series_id, t, round(l, 4) + 0::double as filt, round(s, 4) + 0::double as fslope from k""")(lambda s, d: L.levels(walk(s, d), grid(s, FIXED), "kalman").select("series_id", "t", rnd("filt", 4).alias("filt"), rnd("fslope", 4).alias("fslope")))

# ---- segments and labels
_SEGS = SQL_C1 + ", segs as (select series_id, run_no as seg_no, greatest(min(t) - 1, 0) as start, max(t) as \"end\", label from crun group by 1, 2, 5)"
query("t11_labels_to_segments", f"with {_SEGS} select series_id, 'fixed1' as setting_id, 'C' as method, seg_no, start::int as start, \"end\"::int as \"end\", label from segs")(lambda s, d: L.collapse(c_labels(s, d, FIXED)))
query("t10_segments_to_labels", f"with {_SEGS} select series_id, 'fixed1' as setting_id, 'C' as method, t::int as t, label from (select series_id, label, unnest(range(case when start = 0 then 0 else start + 1 end, \"end\" + 1)) as t from segs where \"end\" > start or start = 0)")(lambda s, d: L.expand(L.collapse(c_labels(s, d, FIXED))))
query("t12_decorate", f"with {_SEGS}, g as (select s.*, a.month as start_date, b.month as end_date, a.value as y0, b.value as y1, b.sig from segs s join sigs a on a.series_id = s.series_id and a.t = s.start join sigs b on b.series_id = s.series_id and b.t = s.\"end\") select series_id, seg_no, start::int as start, \"end\"::int as \"end\", label, start_date, end_date, y0, y1, round_even((y1 - y0) * 100, 0)::bigint as chg_bp, (\"end\" - start)::int as months, round(abs(y1 - y0) / nullif(sig * sqrt(greatest(\"end\" - start, 1)::double), 0), 5) + 0::double as score, 100::bigint as req_bp from g")(lambda s, d: rounded(L.decorated(L.collapse(c_labels(s, d, FIXED)), walk(s, d), grid(s, FIXED)).drop("setting_id", "method").withColumn("y0", F.col("y0")), 6).withColumn("score", rnd("score", 5)))
query("w12_in_state_since", f"with {SQL_C1} select series_id, 'fixed1' as setting_id, 'C' as method, label, min(t) as since from (select *, max(run_no) over (partition by series_id) as m from crun) where run_no = m group by 1, 4")(lambda s, d: L.in_state_since(c_labels(s, d, FIXED)))
query("g10_label_summary", f"with {_SEGS} select c.*, n_segments, n_up, n_down, n_side, avg_trend_months from (select series_id, 'fixed1' as setting_id, 'C' as method, round(avg((label = 1)::int), 6) as share_up, round(avg((label = 0)::int), 6) as share_side, round(avg((label = -1)::int), 6) as share_down from c1 group by 1) c join (select series_id, count(*) as n_segments, count(*) filter (where label = 1) as n_up, count(*) filter (where label = -1) as n_down, count(*) filter (where label = 0) as n_side, round(coalesce(avg(\"end\" - start) filter (where label <> 0), 0), 6) as avg_trend_months from segs group by 1) using (series_id)")(lambda s, d: rounded(L.label_summary(c_labels(s, d, FIXED))))
query("g11_g12_agreement", f"with {sql_c(FIXED, LOW)}, p as (select series_id, t, max(label) filter (where setting_id = 'fixed1') as x, max(label) filter (where setting_id = 'fixed0.5') as y from c group by 1, 2), k as (select series_id, avg((x = y)::int) as po, avg((x = -1)::int) * avg((y = -1)::int) + avg((x = 0)::int) * avg((y = 0)::int) + avg((x = 1)::int) * avg((y = 1)::int) as pe from p group by 1) select series_id, round(po, 6) as agree, round(case when pe < 1 then (po - pe) / (1 - pe) else 1 end, 6) as kappa from k")(lambda s, d: rounded(L.agreement(c_labels(s, d).withColumn("method", F.col("setting_id")).withColumn("setting_id", F.lit("-"))).where("a = 'fixed1' and b = 'fixed0.5'").select("series_id", "agree", "kappa")))
query("x10_detection_lags", f"with {_SEGS}, live as (select series_id, t, lag(label, 2, 0) over (partition by series_id order by t) as label from c1), h as (select s.series_id, s.seg_no, min(l.t - s.start) filter (where l.t > s.start and l.t <= s.\"end\" and l.label = s.label) as lag from segs s join live l using (series_id) where s.label <> 0 group by 1, 2) select series_id, 'fixed1' as setting_id, 'C' as truth, 'late' as method, count(*) as n, count(lag) as detected, median(lag) as median, round(avg(lag), 6) as mean from h group by 1")(lambda s, d: rounded(L.detection_lags(L.collapse(c_labels(s, d, FIXED)), c_labels(s, d, FIXED).withColumn("label", F.lag("label", 2, 0).over(Window.partitionBy("series_id").orderBy("t"))).withColumn("method", F.lit("late")))))
query("h03_settled_end", f"with {_SEGS} select series_id, 'fixed1' as setting_id, 'C' as method, (case when count(*) > 1 then max(start) + 1 else max(\"end\") + 1 end)::int as settled from segs group by 1")(lambda s, d: L.settled_end(L.collapse(c_labels(s, d, FIXED)), walk(s, d).groupBy("series_id").agg(F.count("*").alias("n"))))
_EV = ", ev as (select series_id, run_no as event, min(t) as start, max(t) as \"end\", label as dir from crun where label <> 0 group by 1, 2, 5)"
query("h04_trend_events", f"with {SQL_C1}{_EV} select * from ev where start between 12 and 70")(lambda s, d: M.trend_events(c_one(s, d).withColumn("truth", F.col("label")), KEY, F.lit(12), F.lit(70)))
query("h08_onehot", f"with {SQL_C1} select series_id, t, (label = -1)::int::double as p_down, (label = 0)::int::double as p_side, (label = 1)::int::double as p_up from c1")(lambda s, d: c_one(s, d).select("series_id", "t", *M.onehot()))
query("h09_climatology", f"with {SQL_C1}, e as (select unnest([40, 60, 80]) as vintage) select series_id, vintage::int as vintage, round(avg((label = -1)::int), 6) as p_down, round(avg((label = 0)::int), 6) as p_side, round(avg((label = 1)::int), 6) as p_up from c1 join e on t <= vintage group by 1, 2")(lambda s, d: c_one(s, d).join(F.broadcast(s.createDataFrame([(40,), (60,), (80,)], "vintage int")), F.col("t") <= F.col("vintage")).groupBy("series_id", "vintage").agg(*[rnd(F.avg((F.col("label") == k).cast("double")), 6).alias(p) for k, p in M.CLASSES]))

# ---- metrics
query("x01_calls", f"with {SQL_FC} select series_id, t, call from called")(lambda s, d: called(s, d).select("series_id", "t", "call"))
_RANK = "(select *, rank() over (partition by series_id order by p_up) + (count(*) over (partition by series_id, p_up) - 1) / 2.0::double as r from fc)"
query("x02_auc", f"with {SQL_FC} select series_id, case when count(*) filter (where truth = 1) > 0 and count(*) filter (where truth <> 1) > 0 then round((sum(r) filter (where truth = 1) - count(*) filter (where truth = 1) * (count(*) filter (where truth = 1) + 1) / 2.0::double) / (count(*) filter (where truth = 1) * count(*) filter (where truth <> 1)), 6) end as auc from {_RANK} group by 1")(lambda s, d: rounded(M.auc(forecasts(s, d), KEY, "p_up", F.col("truth") == 1)))
query("x03_month_metrics", f"""with {SQL_FC},
base as (
  select series_id, count(*) as n_months, avg((call = truth)::int) as acc, avg(power(p_down - (truth = -1)::int, 2) + power(p_side - (truth = 0)::int, 2) + power(p_up - (truth = 1)::int, 2)) as brier,
    avg(-ln(least(greatest(case truth when -1 then p_down when 0 then p_side else p_up end, 1e-6::double), 1))) as logscore from called group by 1),
cls as (select unnest([-1, 0, 1]) as k),
per as (select series_id, k, count(*) filter (where truth = k) as ap, count(*) filter (where call = k) as pp, count(*) filter (where truth = k and call = k) as tp from called cross join cls group by 1, 2),
agg as (select series_id, avg(tp / nullif(ap, 0)::double) as bal_acc, avg(case when ap > 0 then 2.0::double * tp / (pp + ap) end) as macro_f1, sum(pp * ap)::double / power(sum(ap), 2) as pe, 1 - sum(power(ap / n::double, 2)) as clim
  from (select *, sum(ap) over (partition by series_id) as n from per) group by 1)
select series_id, n_months, round(acc, 5) as acc, round(bal_acc, 5) as bal_acc, round(macro_f1, 5) as macro_f1, round(case when pe < 1 then (acc - pe) / (1 - pe) end, 5) as kappa, round(brier + 1e-9::double, 5) as brier, round(1 - brier / nullif(clim, 0), 5) as bss, round(logscore, 5) as logscore from base join agg using (series_id)""")(lambda s, d: M.month_metrics(forecasts(s, d), KEY).select("series_id", "n_months", *[rnd(F.col(c) + (1e-9 if c == "brier" else 0.0), 5).alias(c) for c in ("acc", "bal_acc", "macro_f1", "kappa", "brier", "bss", "logscore")]))
_DEL = _EV + """, hits as (select e.series_id, e.event, min(c.t) as hit from ev e join called c on c.series_id = e.series_id and c.t between e.start and e."end" and c.call = e.dir group by 1, 2),
v as (select series_id, t, value from c1),
delays as (
  select e.series_id, e.event, e.start, e."end", e.dir, (h.hit - e.start)::int as delay,
    case when h.hit is null then 0 when ye.value = y0.value then 1 else least(greatest((ye.value - yd.value) / nullif(ye.value - y0.value, 0), 0), 1) end::double as capture
  from ev e left join hits h using (series_id, event) left join v y0 on y0.series_id = e.series_id and y0.t = e.start - 1 left join v ye on ye.series_id = e.series_id and ye.t = e."end" left join v yd on yd.series_id = e.series_id and yd.t = greatest(h.hit, e.start - 1))"""
query("x04_j10_event_delays", f"with {SQL_FC}{_DEL} select series_id, event, start, \"end\", dir, delay, round(capture, 5) as capture from delays")(lambda s, d: M.event_delays(called(s, d), forecasts(s, d), KEY).withColumn("capture", rnd("capture", 5)))
_FA = """, k0 as (select *, case when call is not distinct from lag(call) over (partition by series_id order by t) then 0 else 1 end as new_call from called),
k1 as (select *, (sum(new_call) over (partition by series_id order by t) - 1)::int as crun_no from k0),
eps as (select series_id, crun_no as run_no, call, min(t) as first, max(t) as last from k1 where call <> 0 group by 1, 2, 3),
fa as (select * from eps e where not exists (select 1 from called c where c.series_id = e.series_id and c.t between e.first and e.last and c.truth = e.call))"""
query("j09_false_alarms", f"with {SQL_FC}{_FA} select series_id, run_no, call, first, last from fa")(lambda s, d: M.false_alarms(called(s, d), forecasts(s, d), KEY))
query("x04_event_metrics", f"""with {SQL_FC}{_DEL}{_FA},
a as (select series_id, count(*) as n_events, avg((delay is not null)::int) as hit_rate, median(delay) as delay_med, avg(delay) as delay_mean, avg((coalesce(delay, 99) <= 3)::int) as within3, avg((coalesce(delay, 99) <= 6)::int) as within6, avg(capture) as capture from delays group by 1),
b as (select series_id, count(*) / 12.0::double as years, sum(f) as f, sum(g) as g from (select series_id, coalesce((call <> lag(call) over w)::int, 0) as f, coalesce((truth <> lag(truth) over w)::int, 0) as g from called window w as (partition by series_id order by t)) group by 1)
select b.series_id, coalesce(n_events, 0) as n_events, round(hit_rate, 5) as hit_rate, delay_med, round(delay_mean, 5) as delay_mean, round(within3, 5) as within3, round(within6, 5) as within6, round(capture, 5) as capture,
  round(10 * coalesce(nf, 0) / years, 5) as false_alarms_10y, round((coalesce(ne, 0) - coalesce(nf, 0)) / nullif(coalesce(ne, 0), 0)::double, 5) as precision, round(f / years, 5) as flips_yr, round(g / years, 5) as truth_flips_yr
from b left join a using (series_id) left join (select series_id, count(*) as ne from eps group by 1) using (series_id) left join (select series_id, count(*) as nf from fa group by 1) using (series_id)""")(lambda s, d: rounded(C.event_scores(called(s, d).withColumn("h", F.lit(0)), forecasts(s, d).drop("p_down", "p_side", "p_up"), KEY).drop("h", "bal_acc"), 5))
query("x05_pnl", f"with {SQL_FC}, p as (select series_id, call, call * (lead(value) over (partition by series_id order by t) - value) * 100 as pnl from called) select series_id, round(12 * avg(pnl), 5) as pnl_bp_yr, round(case when stddev_samp(pnl) > 0 then sqrt(12) * avg(pnl) / stddev_samp(pnl) end, 5) as sharpe, round(avg(case when call <> 0 then (pnl > 0)::int end), 5) as hit, round(avg((call <> 0)::int), 5) as exposure from p where pnl is not null group by 1")(lambda s, d: rounded(M.pnl_metrics(called(s, d), walk(s, d), KEY), 5))


def score_parts(*names):
    """The SQL of queries as the CTEs they are, with the columns of each."""
    return ", ".join(f"{n} as ({SQL[n]})" for n in names)


def scored(s, d):
    f = forecasts(s, d)
    return C.scores(f.select("series_id", F.lit(0).alias("h"), "t", *C.PROBABILITIES), f.select("series_id", "t", "truth", "value"), KEY)


def score_columns(s, d):
    out = scored(s, d).drop("h", "auc_down")
    digits = lambda c: 6 if c == "auc_up" else 5
    return out.select(*[rnd(F.col(c) + (1e-9 if c == "brier" else 0.0), digits(c)).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


query("x06_score", f"""with {score_parts('x02_auc', 'x03_month_metrics', 'x04_event_metrics', 'x05_pnl')}
select x03_month_metrics.*, x02_auc.auc as auc_up, x04_event_metrics.* exclude (series_id), x05_pnl.* exclude (series_id)
from x03_month_metrics join x02_auc using (series_id) join x04_event_metrics using (series_id) join x05_pnl using (series_id)""")(score_columns)
query("x07_dm_statistic", f"""with {SQL_FC}, l as (select series_id, t, power(p_up - (truth = 1)::int, 2) - power(p_down - (truth = -1)::int, 2) as d from fc),
x as (select *, row_number() over (partition by series_id order by t) as i, count(*) over (partition by series_id) as n, avg(d) over (partition by series_id) as m, d - avg(d) over (partition by series_id) as dc from l),
k as (select unnest(range(0, 12)) as k),
g as (select a.series_id, a.n, any_value(a.m) as m, sum((case when k = 0 then 1.0::double else 2 * (1 - k / 12.0::double) end) * a.dc * b.dc) / a.n as lrv from x a cross join k join x b on b.series_id = a.series_id and b.i = a.i - k group by 1, 2)
select series_id, n, round(m, 6) as mean_d, round(m / sqrt(lrv / n) * sqrt((n - 1) / n::double), 5) as stat from g where lrv > 0""")(lambda s, d: M.dm_statistic(forecasts(s, d).select("series_id", "t", (F.pow(F.col("p_up") - (F.col("truth") == 1).cast("double"), 2) - F.pow(F.col("p_down") - (F.col("truth") == -1).cast("double"), 2)).alias("d")), KEY).select("series_id", "n", rnd("mean_d", 6).alias("mean_d"), rnd("stat", 5).alias("stat")))
_HYS = SQL_FC + """, th as (select unnest([0.0, 0.4, 0.5, 0.6])::double as theta), hx as (
  select series_id, theta, t, case when row_number() over (partition by series_id, theta order by t) = 1 or theta <= 0 or (case call when -1 then p_down when 0 then p_side else p_up end) >= theta then call end as firm from called cross join th),
hyst as (select series_id, theta, t, last_value(firm ignore nulls) over (partition by series_id, theta order by t) as call from hx)"""


def with_thetas(rows):
    return rows.withColumn("theta", F.explode(F.array(*map(F.lit, (0.0, 0.4, 0.5, 0.6)))))


def hysteresis(s, d):
    return M.hysteresis_calls(with_thetas(forecasts(s, d)), F.col("theta"), ("series_id", "theta"))


query("x11_hysteresis", f"with {_HYS} select series_id, theta, t, call from hyst")(lambda s, d: hysteresis(s, d).select("series_id", "theta", "t", "call"))
# Every threshold is a series of its own here, so that the SQL of x04 holds for each.
_BY_THETA = SQL_FC.replace(SQL_C1, sql_c(FIXED) + f""", th as (select unnest([{", ".join(map(str, LL.THETAS))}])::double as theta),
c1 as (select c.series_id || '@' || theta as series_id, t, month, value, label from c cross join th),
crun0 as (select *, case when label is not distinct from lag(label) over (partition by series_id order by t) then 0 else 1 end as new from c1),
crun as (select series_id, t, month, value, label, (sum(new) over (partition by series_id order by t) - 1)::int as run_no from crun0)""").replace("called as (", "likely as (") + """,
firmly as (select *, split_part(series_id, '@', 2)::double as theta, case call when -1 then p_down when 0 then p_side else p_up end as top from likely),
firm as (select * exclude (call), case when row_number() over (partition by series_id order by t) = 1 or theta <= 0 or top >= theta then call end as firm from firmly),
called as (select * exclude (firm), last_value(firm ignore nulls) over (partition by series_id order by t) as call from firm)"""
query("x12_frontier", SQL["x04_event_metrics"].replace(SQL_FC, _BY_THETA).replace("select b.series_id,", "select split_part(b.series_id, '@', 1) as series_id, split_part(b.series_id, '@', 2)::double as theta,").replace("from b left join a", "round(bal_acc, 5) as bal_acc from b join (select series_id, avg(r) as bal_acc from (select series_id, avg((call = truth)::int) as r from called group by series_id, truth) group by 1) using (series_id) left join a").replace("as truth_flips_yr", "as truth_flips_yr,"))(
    lambda s, d: rounded(LL.frontier(forecasts(s, d).withColumn("h", F.lit(0)).drop("truth", "value"), forecasts(s, d).select("series_id", "t", "truth", "value")).drop("h"), 5))
_TURN = _EV.replace("where label <> 0", "where label <> 0 and run_no > 0")
query("x13_turns", f"with {SQL_C1}{_TURN} select series_id, start as t, dir from ev")(lambda s, d: LL.turns(c_one(s, d)))
query("j07_nearest_turn", f"with {SQL_C1}{_TURN}, p as (select a.series_id as x, b.series_id as y, b.start as t, b.dir, a.start - b.start as lead, row_number() over (partition by a.series_id, b.series_id, b.start order by abs(a.start - b.start), a.start - b.start) as n from ev a join ev b on a.dir = b.dir and a.series_id <> b.series_id and abs(a.start - b.start) <= 12) select x, y, t, dir, lead from p where n = 1")(lambda s, d: LL.nearest_turns(LL.turns(c_one(s, d)), LL.turns(c_one(s, d)), LL.all_pairs(c_one(s, d), c_one(s, d))))
query("j08_concordance", f"with {SQL_C1}, k as (select unnest(range(-12, 13)) as lag), p as (select a.series_id as x, b.series_id as y, lag::int as lag, avg((a.label = b.label)::int) as share from c1 a cross join k join c1 b on b.t = a.t + lag and a.series_id <> b.series_id group by 1, 2, 3 having count(*) > 60) select x, y, lag, round(share, 6) as share from p")(lambda s, d: rounded(LL.concordance(c_one(s, d), c_one(s, d), LL.all_pairs(c_one(s, d), c_one(s, d)))))
query("x15_lead_lag", f"""with {score_parts('j07_nearest_turn', 'j08_concordance')},
conc as (select x, y, max(share) filter (where lag = 0) as share0, max(share) as best_share, first(lag order by share desc, lag) as best_lag from j08_concordance group by 1, 2),
near as (select x, y, count(*) as matched, round(avg((lead < 0)::int), 6) as led, median(lead) as lead_med, round(avg(lead), 6) as lead_mean from j07_nearest_turn group by 1, 2)
select * from conc left join near using (x, y)""")(lambda s, d: rounded(LL.lead_lag(c_one(s, d), c_one(s, d))))
