"""State of several kinds, a box of any length, and a step loop that is stopped and started again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import walkforward as G
from tideline.plans import study_queries as Q
from tideline.plans.base import walk
from tideline.streaming import live, stateful


def scanned(y, rule, legs, stall):
    """The machine with Rule.breakout(), which looks at every start of the box."""
    m, live = K.Machine(rule, legs, stall), np.zeros(len(y), dtype=int)
    m.breakout = lambda y, t: None if (f := rule.breakout(y, m.start, t)) is None else (f[0], y[f[0]], f[1])
    for t in range(1, len(y)):
        m.step(y, t)
        live[t] = m.state
    return live


def test_box_of_extremes_equals_the_scan():
    draw = np.random.default_rng(5)
    for _ in range(300):
        y = np.cumsum(draw.normal(0, draw.choice([0.05, 0.3, 1.0]), draw.integers(5, 150))).round(int(draw.choice([1, 2, 6])))
        s = K.Setting(thr=float(draw.choice([0.0, 0.3, 1.0, 3.0])), scaled=bool(draw.integers(2)), z=float(draw.choice([0.5, 1.0, 2.0])), min_len=int(draw.choice([0, 3, 15])), cap=int(draw.choice([1, 4, 12])))
        rule = K.Rule(s, K.rolling_sigma(y))
        for legs, stall in ((False, 6), (True, 12)):
            assert (K.run_machine(y, rule, legs)[1] == scanned(y, rule, legs, stall)).all(), s


@pytest.mark.parametrize("scaled", [False, True])
def test_state_stays_small(scaled):
    f = live.Follower(K.Setting(thr=50.0, scaled=scaled, z=50.0), True)
    draw, sizes = np.random.default_rng(0), []
    for v in draw.normal(size=2000):
        assert f.read(float(v)) == 0
        f = live.Follower(f.setting, True).load(f.dump())
        sizes.append((len(f.y), len(json.dumps(f.parts()))))
    assert max(n for n, _ in sizes) <= 13 and max(b for _, b in sizes[100:]) < 2500
    up = live.Follower(K.Setting(thr=1.0), True)
    assert {up.read(float(k)) for k in range(500)} == {0, 1} and len(up.y) == 1


@pytest.mark.parametrize("legs", [False, True])
def test_machine_state_equals_batch(spark, sf, legs):
    s = K.Setting(thr=0.8, scaled=True, z=1.0, min_len=2)
    stream = live.replay(walk(spark, sf).select("series_id", "month", "value"), "month", 5)
    order = ["series_id", "t"]
    got = stateful.drained(stateful.machine_states(stream, s, legs)).toPandas().sort_values(order, ignore_index=True)
    want = live.drain(live.live_states(live.replay(walk(spark, sf).select("series_id", "month", "value"), "month", 3), s, legs)).toPandas().sort_values(order, ignore_index=True)
    assert got.equals(want) and set(got["label"]) == {-1, 0, 1}
    assert spark.conf.get(stateful.STORE[0], None) != stateful.STORE[1]


def test_step_loop_survives_a_failure(spark, sf, tmp_path):
    detectors = [G.Climatology(), G.RuleDetector(), G.Supervised(Q.OWN, name="Logit own", options={"c": 0.1})]
    rows, b, path = Q.features(spark, sf).withColumn("at", F.timestamp_seconds(F.col("t"))), Q.bounds(spark, sf), f"file://{tmp_path}/steps"
    stream = lambda: live.replay(rows, "at", 5).drop("at")
    source, seen = stream(), []

    def fails_once(number):
        seen.append(number)
        if number == 3 and seen.count(3) == 1:
            raise RuntimeError("lost after the forecasts were written")

    with pytest.raises(Exception, match="lost after"):
        stateful.step_loop(source, b, detectors, Q.SETTING, path, after=fails_once)
    got = stateful.step_loop(source, b, detectors, Q.SETTING, path, after=fails_once).toPandas()
    assert seen.count(3) == 2 and seen.count(2) == 1
    want = Q.forecasts(spark, sf, detectors).toPandas()
    key = ["series_id", "detector", "refit", "t", "h"]
    assert len(got) == len(want) == len(got.drop_duplicates(key))
    both = got.merge(want, on=key)
    assert len(both) == len(want) and all(np.allclose(both[f"{p}_x"], both[f"{p}_y"], atol=1e-8) for p in ("p_down", "p_side", "p_up"))
