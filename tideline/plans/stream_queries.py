"""Queries that replay tables as streams; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators.tables import folder
from tideline.plans import label_queries, study_queries
from tideline.plans.base import forecasts, rnd, walk
from tideline.plans.machine_sql import LIVE_A, LIVE_D
from tideline.streaming import live as S
from tideline.streaming import stateful as T

Q: dict = {}
SQL: dict[str, str] = {}
SETTING = K.Setting(thr=1.0)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def months(s, d):
    return S.replay(walk(s, d).select("series_id", "month", "value"), "month")


def with_month(sql: str) -> str:
    """The SQL of a live machine with its months."""
    return sql.replace("select series_id, 'fixed1' as setting_id, 'A_rt' as method, t::int as t, state::int as label from m", "select series_id, walk.month, t::int as t, state::int as label from m join walk using (series_id, t)").replace("select series_id, 'fixed1' as setting_id, 'D_rt' as method, t::int as t, state::int as label from m", "select series_id, walk.month, t::int as t, state::int as label from m join walk using (series_id, t)")


query("stream_live_d", with_month(LIVE_D))(lambda s, d: S.drain(S.live_states(months(s, d), SETTING)))
query("stream_live_a", with_month(LIVE_A))(lambda s, d: S.drain(S.live_states(months(s, d), SETTING, False)))
query("n01_machine_state_d", with_month(LIVE_D))(lambda s, d: T.drained(T.machine_states(months(s, d), SETTING)))
query("n01_machine_state_a", with_month(LIVE_A))(lambda s, d: T.drained(T.machine_states(months(s, d), SETTING, False)))


def soft(s, d):
    """The made forecasts at four thresholds, as a stream in order of months."""
    rows = label_queries.with_thetas(forecasts(s, d)).withColumn("at", F.timestamp_seconds(F.col("t")))
    return S.replay(rows, "at")


query("n06_confirmed_calls", label_queries.SQL["x11_hysteresis"])(lambda s, d: T.drained(T.confirmed_calls(soft(s, d))))


def stepped(s, d):
    rows = study_queries.features(s, d).withColumn("at", F.timestamp_seconds(F.col("t")))
    return T.step_loop(S.replay(rows, "at", 6).drop("at"), study_queries.bounds(s, d), study_queries.rules(), SETTING, folder(s, "steps"))


query("n02_step_loop", study_queries.SQL["h09_h10_rule_forecasts"])(stepped)


def orders(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_orderpriority", "o_totalprice")
    return S.replay(o.withColumn("ts", F.col("o_orderdate").cast("timestamp")).drop("o_orderdate"), "ts")


# Months that the watermark, 31 days behind the last one seen, has not passed stay open.
query("stream_monthly_buckets", "select o_orderpriority as series_id, date_trunc('month', o_orderdate)::date as month, round(avg(o_totalprice), 4) as value, count(*) as n from orders where date_trunc('month', o_orderdate) <= (select date_trunc('month', max(o_orderdate)) - interval 31 day from orders) group by 1, 2")(
    lambda s, d: S.drain(S.monthly(orders(s, d), "ts", F.col("o_totalprice"), F.col("o_orderpriority"))).select("series_id", "month", rnd("value", 4).alias("value"), "n"))
