"""The whole study over the driver's tables: the price walks by return flag are the targets, those by nation of the supplier the candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import labelers as L
from tideline.operators import leadlag as LL
from tideline.operators import matrix as X
from tideline.operators import metrics as M
from tideline.operators import panel as P
from tideline.operators import scoring as C
from tideline.operators import walkforward as G
from tideline.operators.tables import written
from tideline.plans import machine_sql as MS
from tideline.plans.base import FIXED, SQL_FC, grid, kept, rnd, walk
from tideline.plans.base import forecasts as plain_forecasts
from tideline.sources import series as S

Q: dict = {}
SQL: dict[str, str] = {}
SETTING = K.Setting(thr=1.0)
OWN = X.OWN
#: The candidates' tiers, and which of them are rates; n0 is the walk of nation 0.
TIERS = {"L": "1998-01-01", "M": "1998-07-01", "S": "1999-01-01"}
RATES, LATE = ("n0", "n1", "n2", "n4", "n16", "n17", "n18"), {"M": "1995-07-01", "S": "1996-01-01"}
VARIABLES = {f"n{k}": X.Variable("L" if k < 13 else "M" if k < 16 else "S", f"Nation {k}", f"n{k}" in RATES, f"n{k}" in RATES) for k in range(19)} | {"mm": X.Variable("L", "Momentum of five nations")}
BLOCKS = {
    "B_rates": (("n0", "n1", "n2"), "L", "Nations 0 to 2"), "B_five": (("n3", "n4", "n5", "n6", "n7"), "L", "Nations 3 to 7"), "B_two": (("n8", "n9"), "L", "Nations 8 and 9"),
    "B_three": (("n10", "n11", "n12"), "L", "Nations 10 to 12"), "B_middle": (("n13", "n14", "n15"), "M", "Nations 13 to 15"), "B_short": (("n16", "n17", "n18"), "S", "Nations 16 to 18"),
}
STUDY = X.Study(VARIABLES, BLOCKS, TIERS, OWN, "mm", options={"logit": {"least": 24, "options": {"c": 0.1}}, "boosted": {"least": 24, "options": {"rounds": 60, "leaf": 8}}})


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _months(s, d) -> DataFrame:
    """Mean prices by month and nation. Kept, as the levels read them several times: 19 rows a month, however long lineitem is."""
    li, su = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_extendedprice"), s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return li.join(su.where("s_nationkey < 19"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("series_id"), S.month_of("l_shipdate").alias("month")).agg(F.round(F.avg("l_extendedprice") / 1e4, 6).alias("value"))


def panel(s, d) -> DataFrame:
    """The walks of 19 nations on a spine, those that aren't rates above 100, those of later tiers from their first month on."""
    whole = Window.partitionBy("series_id")
    months = kept("matrix_months", s, d, lambda: _months(s, d)).withColumn("last", F.max("month").over(whole)).where(F.col("month") < F.col("last"))
    steps = months.withColumn("z", (F.col("value") - F.avg("value").over(whole)) / F.stddev_samp("value").over(whole))
    walks = steps.select("series_id", "month", F.round(F.sum("z").over(whole.orderBy("month")), 6).alias("value"))
    walks = walks.withColumn("value", F.when(F.col("series_id").isin(*RATES), F.col("value")).otherwise(F.col("value") + 100))
    since = reduce(lambda c, n: c.when(F.col("series_id") == n, F.lit(LATE[VARIABLES[n].tier]).cast("date")), [n for n, v in VARIABLES.items() if v.tier in LATE], F.when(F.lit(False), F.lit(None).cast("date")))
    return S.spine(walks.where(since.isNull() | (F.col("month") >= since)))


def meta(s) -> DataFrame:
    return s.createDataFrame([(n, "rate" if v.rate_like else "price", 0 if v.rate_like else 1) for n, v in VARIABLES.items() if n != "mm"], "id string, kind string, pub_lag int")


def levels(s, d) -> DataFrame:
    """The candidates as they were known, with the momentum made of them."""
    base = P.level(P.realtime(panel(s, d), meta(s)), meta(s))
    mm = P.macro_momentum(base, {"n3": 1, "n4": 1, "n5": 1, "n6": 1, "n7": -1}, least=12).select(F.lit("mm").alias("series_id"), "month", "value")
    return written(base.unionByName(mm), "levels")


def features(s, d) -> DataFrame:
    """(series_id, t, month, value, sig, own features, and of each candidate its level and compact features)."""
    return kept("matrix_features", s, d, lambda: _features(s, d))


def _features(s, d) -> DataFrame:
    return X.panel_features(L.with_sigma(walk(s, d)), L.machine_labels(walk(s, d), grid(s, FIXED), ("D_rt",)), levels(s, d), VARIABLES)


def bounds(s, d) -> DataFrame:
    """(series_id, tier, e0, e1)."""
    return kept("matrix_bounds", s, d, lambda: _bounds(s, d))


def _bounds(s, d) -> DataFrame:
    series = walk(s, d)
    settled = L.settled_end(L.machine_segments(series, grid(s, FIXED), ("D",)), series.groupBy("series_id").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, [G.bounds(series, settled, start).select("series_id", F.lit(t).alias("tier"), "e0", "e1") for t, start in TIERS.items()])


def truth(s, d) -> DataFrame:
    return kept("matrix_truth", s, d, lambda: L.machine_labels(walk(s, d), grid(s, FIXED), ("D",)).select("series_id", "t", F.col("label").alias("truth")).join(walk(s, d).select("series_id", "t", "value"), ["series_id", "t"]))


def made(s, d) -> DataFrame:
    """The forecasts of all jobs, written once a session and folder: every table of the study starts from them."""
    jobs = [*X.all_jobs(STUDY), *X.frontier_jobs(STUDY, "n4", ("n3", "n5", "n1"), ("L", "M"))]
    return kept("matrix_forecasts", s, d, lambda: written(X.forecasts(features(s, d), X.job_table(s, jobs), bounds(s, d), SETTING, STUDY), "forecasts"))


def study(s, d, draws: int = 500) -> dict[str, DataFrame]:
    board = kept("matrix_board", s, d, lambda: X.scored(made(s, d), bounds(s, d), truth(s, d)))
    return X.run(features(s, d), bounds(s, d), truth(s, d), walk(s, d), SETTING, STUDY, draws, made=made(s, d), board=board)


def found(s, d) -> DataFrame:
    """The true trends of each tier, which need no forecasts."""
    return X.events(X.evaluated(truth(s, d), bounds(s, d)), bounds(s, d), walk(s, d))


def frontier(s, d) -> DataFrame:
    """Nine detectors on two tiers and two horizons over twelve thresholds."""
    rows = made(s, d).where("detector like 'Frontier: %' and h in (0, 3)").select(*X.RUN, "h", "t", *C.PROBABILITIES)
    return LL.frontier(rows, X.evaluated(truth(s, d), bounds(s, d)), keys=tuple(X.RUN), plain=X.CERTAIN)


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, arrays as text."""
    cols = [rnd(c, digits).alias(c) if k == "double" else F.array_join(c, ",").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes]
    return df.select(*cols)


query("z05_study_forecasts")(made)
query("x18_study_leaderboard")(lambda s, d: flat(study(s, d)["leaderboard"]))
query("z05_full_study_add_one")(lambda s, d: flat(study(s, d)["add_one"]))
query("z05_full_study_leave_one_out")(lambda s, d: flat(study(s, d)["leave_one_out"]))
query("x18_study_events")(found)
query("x18_study_paths")(lambda s, d: study(s, d)["paths"])
query("z05_study_tiers")(lambda s, d: X.spans(bounds(s, d), walk(s, d), found(s, d)))
query("x20_study_findings")(lambda s, d: flat((lambda t: X.findings(t["add_one"], t["leaderboard"]))(study(s, d))))
query("x12_study_frontier")(lambda s, d: flat(frontier(s, d)))


def few(s, d) -> DataFrame:
    """The matched test of three variables in four models at two horizons."""
    names = ("n0", "n5", "mm")
    some = X.Study({n: X.Variable("T", VARIABLES[n].label, VARIABLES[n].rate_like, VARIABLES[n].spread) for n in names}, {}, {"T": TIERS["L"]}, OWN, "mm", (0, 3), options=STUDY.options)
    b = bounds(s, d).where("tier = 'L'").withColumn("tier", F.lit("T"))
    return X.matched_test(features(s, d), b, truth(s, d), walk(s, d), SETTING, some, ("logit", "gbm", "ms-tvtp", "rule"), 100)


query("x19_matched_test")(lambda s, d: flat(few(s, d)))

_SPANS = f"""{MS.ex_post(True, FIXED)}, {", ".join(MS.bounds_sql(start, f"bnd_{t}") for t, start in TIERS.items())},
bnd as ({" union all ".join(f"select series_id, '{t}' as tier, e0, e1 from bnd_{t}" for t in TIERS)}),
last as (select series_id, max(e1) as top from bnd group by 1),
tr as (select lab.series_id, lab.t, lab.label from lab join last using (series_id) where lab.t <= top),
rn as (select *, sum(new) over (partition by series_id order by t) as run from (select *, case when label is not distinct from lag(label) over (partition by series_id order by t) then 0 else 1 end as new from tr)),
cut as (select rn.*, tier, e0, e1 from rn join bnd using (series_id) where rn.t <= e1),
found as (select series_id, tier, min(t) as first, max(t) as last, any_value(label) as dir, any_value(e0) as e0 from cut where label <> 0 group by series_id, tier, run having min(t) >= any_value(e0)),
events as (
  select f.series_id, f.tier, strftime(a.month, '%Y-%m') as start, strftime(b.month, '%Y-%m') as "end", f.dir::int as dir, round_even(100 * (b.value - p.value), 0)::int as move_bp
  from found f join walk a on a.series_id = f.series_id and a.t = f.first join walk b on b.series_id = f.series_id and b.t = f.last left join walk p on p.series_id = f.series_id and p.t = f.first - 1)"""
SQL["x18_study_events"] = f"with {_SPANS} select * from events"
SQL["z05_study_tiers"] = f"""with {_SPANS} select b.series_id, b.tier, b.e1, b.e0, strftime(w0.month, '%Y-%m') as eval_start, strftime(w1.month, '%Y-%m') as eval_end, (select count(*) from events e where e.series_id = b.series_id and e.tier = b.tier) as n_events
from bnd b join walk w0 on w0.series_id = b.series_id and w0.t = b.e0 join walk w1 on w1.series_id = b.series_id and w1.t = b.e1"""


def calls(s, d) -> DataFrame:
    """Two calls on each month of the walk: the likeliest state of made forecasts, and the truth two months late."""
    rows = plain_forecasts(s, d)
    return rows.select("series_id", "t", "truth", M.calls().alias("call_a"), F.lag("truth", 2, 0).over(Window.partitionBy("series_id").orderBy("t")).alias("call_b"))


query("x08_block_bootstrap", f"""with {SQL_FC},
p as (select series_id, t, truth, call as call_a, lag(truth, 2, 0) over (partition by series_id order by t) as call_b from called),
n as (select series_id, count(*) as n from p group by 1),
draws as (select unnest(range(200)) as draw),
starts as (
  select series_id, draw, block, n, cast(floor(cast('0x' || substr(md5('0:' || draw || ':' || block), 1, 8) as bigint) / 4294967296.0::double * (n - 24 + 1)) as bigint) as first
  from (select *, unnest(range(cast(ceil(n / 24.0) as bigint))) as block from n cross join draws)),
resampled as (select s.series_id, draw, truth, call_a, call_b from (select *, unnest(range(least(24, n - block * 24))) as k from starts) s join p on p.series_id = s.series_id and p.t = s.first + s.k),
recall as (select series_id, draw, truth, avg((call_a = truth)::int) - avg((call_b = truth)::int) as gain from resampled group by 1, 2, 3),
gains as (select series_id, draw, avg(gain) as gain from recall group by 1, 2)
select series_id, round(quantile_cont(gain, 0.05), 6) as ci_low, round(quantile_cont(gain, 0.95), 6) as ci_high, round(avg((gain <= 1e-12)::int), 6) as p_boot from gains group by 1""")(lambda s, d: flat(C.bootstrap(calls(s, d), ["series_id"], 200)))
