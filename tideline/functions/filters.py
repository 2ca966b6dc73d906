"""The forward filter of a Markov model as expressions: chances of hidden states month by month, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum_exp(x: Column) -> Column:
    """log(sum(exp(x))) of an array, without overflow."""
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def forward(observed: Column, mean: Column, variance: Column, first: Column, moves: Column) -> Column:
    """An array of the chances of each month's states by what is seen to it.

    observed: array of one number a month; mean, variance and first: arrays by state; moves: for each month an array, by the state left, of arrays of chances by the state entered (a month's moves lead to the next). One fold over the months in logs, so that long series don't underflow.
    """
    states = F.sequence(F.lit(0), F.size(mean) - 1)
    seen = lambda t: F.transform(states, lambda k: -0.5 * (F.pow(F.get(observed, t) - F.get(mean, k), F.lit(2.0)) / F.get(variance, k) + F.log(2 * F.pi() * F.get(variance, k))))
    log = lambda x: F.log(x + F.lit(1e-300))
    scaled = lambda x: F.transform(x, lambda v: v - log_sum_exp(x))
    at_first = scaled(F.zip_with(F.transform(first, log), seen(F.lit(0)), lambda a, b: a + b))

    def step(state: Column, t: Column) -> Column:
        came = F.transform(states, lambda k: log_sum_exp(F.transform(states, lambda i: F.get(state["now"], i) + log(F.get(F.get(F.get(moves, t - 1), i), k)))))
        now = scaled(F.zip_with(came, seen(t), lambda a, b: a + b))
        return F.struct(now.alias("now"), F.array_append(state["out"], F.transform(now, F.exp)).alias("out"))

    start = F.struct(at_first.alias("now"), F.array(F.transform(at_first, F.exp)).alias("out"))
    months = F.when(F.size(observed) > 1, F.sequence(F.lit(1), F.size(observed) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(observed) > 0, F.aggregate(months, start, step, lambda s: s["out"]))
