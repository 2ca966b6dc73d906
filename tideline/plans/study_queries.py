"""Queries on walk-forward evaluation and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import windows as W
from tideline.operators import kernels as K
from tideline.operators import labelers as L
from tideline.operators import leadlag as LL
from tideline.operators import study as S
from tideline.operators import walkforward as G
from tideline.plans import machine_sql as MS
from tideline.plans.base import FIXED, SQL_C1, c_one, grid, kept, rnd, walk
from tideline.plans.series_queries import SQL_LEVEL, levels, live

Q: dict = {}
SQL: dict[str, str] = {}
OWN = ("d1", "d3", "d12", "vol12")
SETTING = K.Setting(thr=1.0)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def features(s, d) -> DataFrame:
    """The walk with its volatility, own features and a predictor as it was known."""
    return kept("features", s, d, lambda: _features(s, d))


def _features(s, d) -> DataFrame:
    base = L.with_sigma(walk(s, d))
    own = W.with_columns(base, [("d1", W.diff("value")), ("d3", W.diff("value", 3)), ("d12", W.diff("value", 12)), ("vol12", W.rolling(F.stddev_samp, "dy", 12))])
    x = live(s, d).where("series_id = '2-HIGH'").select("month", F.col("value").alias("x"))
    return own.join(x, "month", "left")


def truth(s, d) -> DataFrame:
    return L.machine_labels(walk(s, d), grid(s, FIXED), ("D",)).select("series_id", "t", F.col("label").alias("truth")).join(walk(s, d).select("series_id", "t", "value"), ["series_id", "t"])


def bounds(s, d) -> DataFrame:
    return kept("bounds", s, d, lambda: _bounds(s, d))


def _bounds(s, d) -> DataFrame:
    series = walk(s, d)
    segs = L.machine_segments(series, grid(s, FIXED), ("D",))
    return G.bounds(series, L.settled_end(segs, series.groupBy("series_id").agg(F.count("*").alias("n"))), "1998-01-01")


def evaluated_truth(s, d) -> DataFrame:
    return kept("truth", s, d, lambda: truth(s, d).join(bounds(s, d), "series_id").where("t <= e1").drop("e0", "e1"))


def forecasts(s, d, detectors) -> DataFrame:
    return G.run(features(s, d), G.schedule(bounds(s, d)), detectors, SETTING)


def rules():
    return [G.Climatology(), G.RuleDetector(), G.RuleDetector(False, "Rule A")]


query("h05_schedule", f"with {SQL_C1}, b as (select series_id, min(t) filter (where month >= date '1998-01-01') as e0, max(t) as e1 from c1 group by 1) select series_id, unnest(range(e0 - 1, e1, 12))::int as refit, least(unnest(range(e0 - 1, e1, 12)) + 12, e1)::int as last from b")(lambda s, d: G.schedule(c_one(s, d).groupBy("series_id").agg(F.min(F.when(F.col("month") >= "1998-01-01", F.col("t"))).alias("e0"), F.max("t").alias("e1"))))
query("p07_bounds", f"with {MS.ex_post(True, FIXED)}, {MS.bounds_sql('1998-01-01')} select * from bnd")(bounds)
VINT = "vint as (select unnest([48, 60, 72]) as vintage)"
query("h02_vintage_labels_d", f"with recursive {MS.walk_source()}, {MS.config(FIXED)}, {MS.machine(True)}, {VINT}, {MS.settled(vintage=True)}, {MS.expanded(vintage=True)} select series_id || '@' || vintage as series_id, setting_id, 'D' as method, t, label from lab")(
    lambda s, d: L.machine_labels(L.vintages(walk(s, d), s.createDataFrame([(48,), (60,), (72,)], "T int")), grid(s, FIXED), ("D",)))
query("h02_vintage_labels")(lambda s, d: L.machine_labels(L.vintages(walk(s, d), s.createDataFrame([(48,), (60,), (72,)], "T int")), grid(s, FIXED), ("D", "G")))
FORECAST = f"""recursive {MS.walk_source()}, {MS.config(FIXED)}, {MS.machine(True)}, {MS.machine(False, "ma")}, {MS.settled()}, {MS.bounds_sql('1998-01-01')},
refits as (select series_id, e1, unnest(range(e0 - 1, e1, 12)) as refit from bnd where e1 >= e0),
vint as (select distinct refit as vintage from refits), {MS.settled("m", "vseg", True)}, {MS.expanded("vseg", "vlab", True)},
months as (select series_id, refit, unnest(range(refit + 1, least(refit + 12, e1) + 1)) as t from refits),
share as (select series_id, vintage as refit, avg((label = -1)::int) as p_down, avg((label = 0)::int) as p_side, avg((label = 1)::int) as p_up from vlab group by 1, 2),
hot as (select series_id, 'Rule D' as detector, t, (state = -1)::int::double as p_down, (state = 0)::int::double as p_side, (state = 1)::int::double as p_up from m union all select series_id, 'Rule A', t, (state = -1)::int::double, (state = 0)::int::double, (state = 1)::int::double from ma),
now as (select series_id, detector, refit, t, p_down, p_side, p_up from months join hot using (series_id, t) union all select series_id, 'Climatology', refit, t, p_down, p_side, p_up from months join share using (series_id, refit)),
made as (select series_id, detector, refit::int as refit, t::int as t, unnest([0, 3])::int as h, p_down, p_side, p_up from now)"""
query("h09_h10_rule_forecasts", f"with {FORECAST} select * from made")(lambda s, d: forecasts(s, d, rules()))
query("h11_composite_rule")(lambda s, d: forecasts(s, d, [G.CompositeRule("x")]))
query("h13_logit")(lambda s, d: forecasts(s, d, [G.Supervised(OWN, name="Logit own"), G.Supervised((*OWN, "x"), name="Logit + x")]))
query("h14_boosted")(lambda s, d: forecasts(s, d, [G.Supervised(OWN, "boosted", "Boosted own", options={"rounds": 60})]))
query("h15_h20_switching")(lambda s, d: forecasts(s, d, [G.SwitchingDetector(), G.SwitchingDetector(inputs=("x",), name="MS inputs"), G.SwitchingDetector(observed=("x",), name="MS observed")]))
query("h18_switching_em")(lambda s, d: forecasts(s, d, [G.SwitchingDetector(labelled=False, name="MS free")]))
query("x16_first_usable", f"with {SQL_C1}, x as (select series_id, t, value - lag(value, 12) over (partition by series_id order by t) as d12 from c1) select series_id, min(t) filter (where d12 is not null) as train_from from x group by 1")(lambda s, d: G.first_usable(features(s, d), ["d12"]))
query("x18_leaderboard")(lambda s, d: S.leaderboard(forecasts(s, d, [*rules(), G.Supervised(OWN, name="Logit own"), G.SwitchingDetector()]), evaluated_truth(s, d)))
query("x09_compare")(lambda s, d: S.compare(forecasts(s, d, [*rules(), G.Supervised(OWN, name="Logit own")]), evaluated_truth(s, d), "Logit own", "Climatology", draws=200))
query("x17_add_one")(lambda s, d: S.all_against(forecasts(s, d, [G.Supervised(OWN, name="base"), G.Supervised((*OWN, "x"), name="base+x"), G.RuleDetector(), G.CompositeRule("x")]), evaluated_truth(s, d), [("base+x", "base"), ("Rule+x", "Rule D")], draws=100))
query("x20_findings", f"""with {FORECAST}, {MS.expanded()},
r as (select made.*, lab.label as truth from made join lab using (series_id, t) where h = 0),
b as (select series_id, detector, avg(power(p_down - (truth = -1)::int, 2) + power(p_side - (truth = 0)::int, 2) + power(p_up - (truth = 1)::int, 2)) as brier, 1 - power(avg((truth = -1)::int), 2) - power(avg((truth = 0)::int), 2) - power(avg((truth = 1)::int), 2) as clim from r group by 1, 2),
g as (select series_id, detector, round(1 - brier / nullif(clim, 0), 6) as bss from b)
select series_id, detector, bss from (select *, row_number() over (partition by series_id order by bss desc nulls last, detector) as n from g) where n = 1""")(lambda s, d: S.best_model(S.leaderboard(forecasts(s, d, rules()), evaluated_truth(s, d), (0,)).withColumn("bss", rnd("bss", 6))))
query("x14_own_truth", f"""with recursive {SQL_LEVEL}, own as (select series_id, month, value, row_number() over (partition by series_id order by month) - 1 as t, count(*) over (partition by series_id) as n from levels where value is not null),
{MS.source("select series_id, t, value from own where n > 40")}, {MS.config(FIXED)}, {MS.machine(True)}, {MS.settled()}, {MS.expanded()} select lab.series_id, lab.t, lab.label, own.month from lab join own using (series_id, t)""")(lambda s, d: LL.own_truth(levels(s, d), grid(s, FIXED)))
