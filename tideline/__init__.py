"""Trend states of time series on Spark."""

from tideline.operators.labelers import machine_labels, machine_segments, method_c
from tideline.operators.matrix import Study, Variable, matched_test
from tideline.operators.panel import level, realtime
from tideline.operators.scoring import scores
from tideline.operators.study import compare, leaderboard
from tideline.operators.walkforward import Agent, Climatology, CompositeRule, Env, RuleDetector, Supervised, SwitchingDetector
from tideline.sources.series import load_panel, read_csv

__all__ = [
    "Agent", "Climatology", "CompositeRule", "Env", "RuleDetector", "Study", "Supervised", "SwitchingDetector", "Variable", "compare", "leaderboard", "level", "load_panel", "machine_labels", "machine_segments", "matched_test", "method_c",
    "read_csv", "realtime", "scores",
]
