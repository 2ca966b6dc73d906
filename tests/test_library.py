import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import cli
from tideline.functions import stats
from tideline.operators import kernels as K
from tideline.operators import labelers as L
from tideline.operators import metrics as M
from tideline.operators import panel as P
from tideline.operators import study
from tideline.operators import walkforward as G
from tideline.plans.base import FIXED, grid, walk
from tideline.plans.study_queries import OWN, SETTING, bounds, evaluated_truth, features, forecasts
from tideline.sources import series as S
from tideline.streaming import live


def test_csv_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date,Rate\n2020-01-01,1.5\n2020-02-01,x\n,3\n2020-03-01,2.5\n")
    rows = S.read_csv(spark, f"file://{p}").collect()
    assert [(r["month"], r["value"]) for r in rows] == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 3, 1), 2.5)]
    z = S.zigzag(spark)
    S.write_labels(L.machine_labels(z, grid(spark, FIXED), ("A", "D")).join(z.select("t", "month"), "t"), ["A", "D"], f"file://{tmp_path}/labels")
    S.write_segments(L.machine_segments(z, grid(spark, FIXED), ("D",)), f"file://{tmp_path}/segments")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/labels").columns == ["series_id", "month", "A", "D"]
    assert "imp" not in spark.read.option("header", True).csv(f"file://{tmp_path}/segments").columns
    assert S.page("<h1>{{title}}</h1>{{data}}", "T", {"data": "[1]"}) == "<h1>T</h1>[1]"


def test_published_values_and_short_gaps(spark):
    m = [dt.date(2020, k, 1) for k in range(1, 9)]
    panel = spark.createDataFrame([("x", d, v) for d, v in zip(m, [1.0, 2.0, None, None, None, 6.0, None, None])], S.SERIES)
    meta = spark.createDataFrame([("x", 1)], "id string, pub_lag int")
    got = [r["value"] for r in P.realtime(panel, meta).orderBy("month").collect()]
    assert got == [None, 1.0, 2.0, 2.0, 2.0, None, 6.0, None]


def test_machine_table_equals_kernel(spark, sf):
    got = L.machine_labels(walk(spark, sf), grid(spark, FIXED), ("D_rt",)).toPandas()
    for sid, g in walk(spark, sf).toPandas().groupby("series_id"):
        y = g.sort_values("t")["value"].to_numpy()
        want = K.run_machine(y, K.Rule(K.Setting(), K.rolling_sigma(y)), True)[1]
        assert (got[got.series_id == sid].sort_values("t")["label"].to_numpy() == want).all()


def test_perfect_and_late_forecasts(spark, sf):
    truth = evaluated_truth(spark, sf).cache()
    hot = truth.select("series_id", "t", F.lit("perfect").alias("detector"), *M.onehot("truth"), F.lit(0).alias("h"))
    s = study.scored(hot, truth).collect()
    assert all(r["acc"] == 1 and r["bal_acc"] == 1 and r["false_alarms_10y"] == 0 and r["delay_med"] in (0, None) for r in s)
    late = truth.select("series_id", (F.col("t") + 3).alias("t"), F.lit("late").alias("detector"), *M.onehot("truth"), F.lit(0).alias("h"))
    s = study.scored(late, truth).collect()
    assert any(r["delay_med"] == 3 for r in s)


def test_steps_equal_the_batch_run(spark, sf):
    dets = [G.Climatology(), G.RuleDetector(), G.Supervised(OWN, name="Logit own", options={"c": 0.1})]
    batch = forecasts(spark, sf, dets).toPandas()
    f, b = features(spark, sf).toPandas(), bounds(spark, sf).toPandas().set_index("series_id")
    sid = "A"
    g = f[f.series_id == sid].sort_values("t")
    env = G.Env(g["value"], g["sig"], SETTING, int(b.e0[sid]), int(b.e1[sid]), {c: g[c].to_numpy(float) for c in OWN})
    for d in dets:
        agent, view, done = G.Agent(d), env.reset(), False
        while not done:
            view, reward, done = env.step(agent.act(env, view))
            assert reward == 0
        one = env.frame().sort_values(["h", "t"])
        two = batch[(batch.series_id == sid) & (batch.detector == d.name)].sort_values(["h", "t"])
        assert np.allclose(one[["p_down", "p_side", "p_up"]], two[["p_down", "p_side", "p_up"]], atol=1e-8), d.name


@pytest.mark.parametrize("kind", ["rule", "logit", "ms"])
def test_forecasts_use_no_later_month(spark, sf, kind):
    d = {"rule": G.RuleDetector(), "logit": G.Supervised(OWN, options={"c": 0.1}), "ms": G.SwitchingDetector()}[kind]
    g = features(spark, sf).where("series_id = 'A'").toPandas().sort_values("t")
    cut = lambda n: G.View(g["value"].to_numpy()[:n], g["sig"].to_numpy()[:n], {c: g[c].to_numpy(float)[:n] for c in OWN}, SETTING, "D", 50, 60, (0, 3))
    a, b = d.predict(cut(61)), d.predict(cut(len(g)))
    assert all(np.allclose(a[h], b[h], atol=1e-8) for h in a)


def test_vintages_are_isolated(spark, sf):
    y = walk(spark, sf).where("series_id = 'A'").toPandas().sort_values("t")["value"].to_numpy()
    got = L.machine_labels(L.vintages(walk(spark, sf).where("series_id = 'A'"), spark.createDataFrame([(50,)], "T int")), grid(spark, FIXED), ("D",)).orderBy("t").toPandas()
    want = K.expand(51, K.run_machine(y[:51], K.Rule(K.Setting(), K.rolling_sigma(y[:51])), True)[0])
    assert (got["label"].to_numpy() == want).all()


@pytest.mark.parametrize("legs", [False, True])
def test_stream_equals_batch(spark, sf, legs):
    s = K.Setting(thr=0.8, scaled=True, z=1.0, min_len=2)
    got = live.drain(live.live_states(live.replay(walk(spark, sf).select("series_id", "month", "value"), "month", 5), s, legs)).toPandas()
    for sid, g in P.causal_sigma(walk(spark, sf)).toPandas().groupby("series_id"):
        g = g.sort_values("t")
        want = K.run_machine(g["value"].to_numpy(float), K.Rule(s, g["sig"].to_numpy(float)), legs)[1]
        assert (got[got.series_id == sid].sort_values("t")["label"].to_numpy() == want).all()
        assert (want != 0).any()


def test_p_values():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_two_sided(1.0, 5) == pytest.approx(0.3632175, abs=1e-6)
    assert stats.wilcoxon(np.array([1.0, 2, 3, -4, 5, 6, 7, 8])) == (4.0, 0.0546875)
    lo, hi, p = stats.block_bootstrap(np.r_[np.ones(60), -np.ones(60)].astype(int), np.ones(120, int), np.r_[np.ones(60), -np.ones(60)].astype(int), 100)
    assert lo > 0 and p <= 0.05


def test_user_series_and_meta(spark):
    m = [dt.date(2020, k, 1) for k in (1, 2, 3)]
    panel = spark.createDataFrame([("x", d, 1.0) for d in m], S.SERIES)
    user = spark.createDataFrame([("u", dt.date(2020, 2, 17), 5.0)], S.SERIES)
    rows, meta = S.with_user_series(panel, user, spark.createDataFrame([("x", "rate"), ("u", "price")], "id string, kind string"), spark.createDataFrame([("u",)], "id string"))
    assert [r["value"] for r in rows.where("series_id = 'u'").orderBy("month").collect()] == [None, 5.0, None]
    assert {r["id"]: (r["group"], r["kind"]) for r in meta.collect()} == {"x": ("user", "rate"), "u": ("user", "rate")}


def test_panel_files_and_command(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,a,b\n2020-01-01,1,\n2020-02-01,2,5\n")
    (tmp_path / "m.csv").write_text("id,kind,pub_lag\na,rate,1\nb,,\n")
    panel, meta = S.load_panel(spark, f"file://{tmp_path}/p.csv", f"file://{tmp_path}/m.csv")
    assert panel.where("value is not null").count() == 3 and {r["id"]: r["pub_lag"] for r in meta.collect()} == {"a": 1, "b": 0}
    S.zigzag(spark).select(F.col("month").alias("Date"), F.col("value").alias("Rate")).coalesce(1).write.option("header", True).csv(f"file://{tmp_path}/z")
    cli.main(["label", f"file://{tmp_path}/z", "--out", f"file://{tmp_path}/out", "--fixed"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/labels").count() == 30


def test_replay_cuts_ranges_without_one_task_for_all(spark):
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 50).cast("string").alias("k"), F.expr("timestamp'2000-01-01' + make_interval(0, 0, 0, cast(pmod(id * 7919, 1400) as int))").alias("ts"), F.col("id").cast("double").alias("v"))
    stream = live.replay(rows, "ts")
    path = stream._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0]
    assert len(spark.read.parquet(path).inputFiles()) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = live.drain(live.monthly(stream, "ts", F.col("v"), F.col("k"))).toPandas()
    want = rows.groupBy(F.col("k").alias("series_id"), F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.avg("v").alias("value"), F.count("v").alias("n")).toPandas()
    both = got.merge(want, on=["series_id", "month", "n"])
    assert len(both) == len(got) == (want["month"] <= got["month"].max()).sum() and (abs(both["value_x"] - both["value_y"]) < 1e-6).all()
