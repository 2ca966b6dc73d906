"""The whole study as one job: which variables help to tell the state of each series in real time.

A study is a table of jobs: a detector, the variables that it reads, the tier (and so the first evaluated month) and the variables from whose first common month it may learn. Series and
jobs are cogrouped, so the features of a series are sent once to each of `lanes` tasks, not once to every detector and refit; a task fits its jobs one after the other
and shares the labels of each vintage among them. Everything after that, scores, paired differences and tests, is relational with the job and the horizon as keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.functions import windows as W
from tideline.operators import kernels as K
from tideline.operators import panel as P
from tideline.operators import scoring as C
from tideline.operators import walkforward as G
from tideline.operators.panel import COMPACT
from tideline.operators.tables import width, written

JOB = "tier string, detector string, kind string, columns array<string>, observed array<string>, inputs array<string>, needs array<string>"
FORECASTS = "series_id string, tier string, detector string, refit int, train_from int, t int, h int, p_down double, p_side double, p_up double"
RUN = ["series_id", "tier", "detector"]


@dataclass(frozen=True)
class Variable:
    """A candidate: the tier from which it has data, a label, and whether it is a rate, of which blends with the target make sense."""

    tier: str
    label: str = ""
    rate_like: bool = False
    spread: bool = False

    def columns(self, name: str) -> list[str]:
        """Its compact features."""
        return [name + c for c in COMPACT if c != "_spr" or self.spread]


@dataclass(frozen=True)
class Study:
    """variables and blocks (name -> (members, tier, label)) of candidates; tiers (name -> first evaluated month), from the longest to the shortest; momentum: the variable whose level, not change, drives transitions."""

    variables: dict[str, Variable]
    blocks: dict[str, tuple[tuple[str, ...], str, str]]
    tiers: dict[str, str]
    own: tuple[str, ...]
    momentum: str | None = None
    horizons: tuple[int, ...] = (0, 3, 6)
    every: int = 12
    options: dict = field(default_factory=dict)  # of detectors, by kind

    def columns(self, names) -> list[str]:
        return [c for n in names for c in self.variables[n].columns(n)]

    def quick(self, names: tuple[str, ...]) -> Study:
        """The study of a few variables, without blocks."""
        return Study({n: v for n, v in self.variables.items() if n in names}, {}, self.tiers, self.own, self.momentum, self.horizons, self.every, self.options)

    def tier_variables(self, tier: str) -> list[str]:
        """Those that have data over a whole tier, without the momentum that is made of them."""
        return [n for n, v in self.variables.items() if self.tiers[v.tier] <= self.tiers[tier] and n != self.momentum]


def _job(study: Study, tier: str, name: str, kind: str, members=(), since=()) -> dict:
    """since: (kind, members) of the models from whose first usable month this one learns."""
    needs = []
    for k, names in since:
        needs += [*study.own, *study.columns(names)] if k in ("logit", "boosted") else [f"{k}:{n}" for n in names]
    columns = [*study.own, *study.columns(members)] if kind in ("logit", "boosted") else list(members) if kind == "blend" else []
    return {"tier": tier, "detector": name, "kind": kind, "columns": columns, "observed": list(members) if kind == "ms_obs" else [], "inputs": list(members) if kind == "ms_tvtp" else [], "needs": needs}


FAMILIES = {"Logit": "logit", "MS-obs": "ms_obs", "MS-tvtp": "ms_tvtp"}


def _pairs(study: Study, name: str, members: tuple[str, ...], tier: str, label: str, families: dict[str, str]) -> tuple[list[dict], list[dict]]:
    """(jobs, pairs) of a candidate: each family with it, against one without it that learns from the same months."""
    jobs, pairs = [], []
    for family, kind in families.items():
        since = () if kind == "blend" else ((kind, members),)
        plain = {"blend": "rule_d", "ms_obs": "ms", "ms_tvtp": "ms"}.get(kind, kind)
        a = _job(study, tier, f"{family}+{name}", kind, members, since)
        b = _job(study, tier, f"Rule D {tier}" if kind == "blend" else f"{plain}, as {kind} of {name}", plain, (), since)
        jobs += [a, b]
        pairs.append({"study": "add_one", "var": name, "members": list(members), "label": label, "tier": tier, "family": family, "aug": a["detector"], "base": b["detector"]})
    return jobs, pairs


def _once(parts) -> tuple[list[dict], list[dict]]:
    """All jobs, each once, and all pairs."""
    jobs, pairs = {}, []
    for own, more in parts:
        jobs |= {(j["tier"], j["detector"]): j for j in own}
        pairs += more
    return list(jobs.values()), pairs


def add_one(study: Study) -> tuple[list[dict], list[dict]]:
    """(jobs, pairs): each candidate alone against a baseline that learns from the same months; members of a block together, without observables but with trees; rates also blended with the target."""
    one = [_pairs(study, n, (n,), v.tier, v.label, FAMILIES | ({"Rule+X": "blend"} if v.rate_like else {})) for n, v in study.variables.items()]
    block = {k: v for k, v in FAMILIES.items() if k != "MS-obs"} | {"Trees": "boosted"}
    return _once(one + [_pairs(study, n, members, tier, label, block) for n, (members, tier, label) in study.blocks.items()])


#: Models of a matched test, by the names of the command.
MODELS = {"logit": "logit", "gbm": "boosted", "ms-obs": "ms_obs", "ms-tvtp": "ms_tvtp", "rule": "blend"}


def matched(study: Study, models: tuple[str, ...] = ("logit", "ms-tvtp")) -> tuple[list[dict], list[dict]]:
    """(jobs, pairs): every variable of the study in each of some models, against the same model without it."""
    return _once(_pairs(study, n, (n,), v.tier, v.label, {m: MODELS[m] for m in models}) for n, v in study.variables.items())


def boards(study: Study) -> list[dict]:
    """Jobs of the leaderboard of each tier: rules, shares, models of the series alone, of all variables, and with momentum."""
    out = []
    for tier in study.tiers:
        names = study.tier_variables(tier)
        since = (("logit", names),)
        of = lambda *a, tier=tier: _job(study, tier, *a)
        out += [of("Rule D (real time)", "rule_d"), of("Rule A (real time)", "rule_a"), of("Climatology", "shares"), of("Logit own", "logit", (), since), of("MS own", "ms", (), since), of("Trees own", "boosted", (), since)]
        out += [of("Logit all X", "logit", names, since), of("Trees all X", "boosted", names, since)]
        if study.momentum in study.variables:
            out += [of("MS tvtp: momentum", "ms_tvtp", (study.momentum,), since), of("Logit + momentum", "logit", (study.momentum,), since)]
    return out


def leave_one_out(study: Study) -> tuple[list[dict], list[dict]]:
    """(jobs, pairs): the logit of all variables of the longest tier against the one without each."""
    tier = next(iter(study.tiers))
    names = study.tier_variables(tier)
    jobs = [_job(study, tier, f"all - {n}", "logit", [m for m in names if m != n], (("logit", names),)) for n in names]
    pairs = [{"study": "leave_one_out", "var": n, "members": [n], "label": study.variables[n].label, "tier": tier, "family": "Logit", "aug": "Logit all X", "base": f"all - {n}"} for n in names]
    return jobs, pairs


def frontier_jobs(study: Study, probe: str, drivers: tuple[str, ...], tiers: tuple[str, ...]) -> list[dict]:
    """Jobs of the trade of delay against false alarms: rules, models of the series alone, a logit with `probe`, and Markov models driven by each of `drivers`; all learn from the first usable month of the logit with `probe`."""
    out, since = [], (("logit", (probe,)),)
    for tier in tiers:
        of = lambda *a, tier=tier: _job(study, tier, *a)
        out += [of("Frontier: Rule D", "rule_d"), of("Frontier: Rule A", "rule_a"), of("Frontier: MS own", "ms", (), since), *[of(f"Frontier: MS + {n}", "ms_tvtp", (n,), since) for n in drivers]]
        out += [of("Frontier: Logit own", "logit", (), since), of(f"Frontier: Logit + {probe}", "logit", (probe,), since), of("Frontier: Trees own", "boosted", (), since)]
    return out


CERTAIN = ("Frontier: Rule D", "Frontier: Rule A")


def all_jobs(study: Study) -> list[dict]:
    return [*add_one(study)[0], *boards(study), *leave_one_out(study)[0]]


def all_pairs(study: Study) -> list[dict]:
    return add_one(study)[1] + leave_one_out(study)[1]


class Shared(G.View):
    """A View whose vintages are kept for all the jobs of a series."""

    memo: dict

    def vintage(self) -> np.ndarray:
        if self.T not in self.memo:
            self.memo[self.T] = super().vintage()
        return self.memo[self.T]


def detector(job, study: Study):
    """The detector of a job's row."""
    options, momentum = study.options.get(job.kind, {}), study.momentum
    if job.kind in ("rule_d", "rule_a"):
        return G.RuleDetector(job.kind == "rule_d")
    if job.kind == "shares":
        return G.Climatology()
    if job.kind == "blend":
        return G.CompositeRule(job.columns[0])
    if job.kind in ("logit", "boosted"):
        return G.Supervised(tuple(job.columns), job.kind, **options)
    return G.SwitchingDetector(tuple(job.observed), tuple(job.inputs), as_is=(momentum,) if momentum else (), **options)


def first_month(columns: dict, value: np.ndarray, needs, study: Study) -> int:
    """The first month in which all columns of `needs` are there; a Markov model's (`ms_obs:x`, `ms_tvtp:x`) is the one after the last gap in what it reads."""
    if not len(needs):
        return 0
    of = lambda kind: tuple(c.split(":", 1)[1] for c in needs if c.startswith(f"{kind}:"))
    observed, inputs = of("ms_obs"), of("ms_tvtp")
    if not observed and not inputs:
        ok = ~np.isnan(np.column_stack([columns[c] for c in needs])).any(axis=1)
        return int(np.argmax(ok)) if ok.any() else 0
    z, u = G.SwitchingDetector(observed, inputs, as_is=(study.momentum,) if study.momentum else ()).sample(value, columns, len(value))
    bad = np.flatnonzero(np.isnan(z).any(axis=1) | (np.isnan(u).any(axis=1) if u is not None else False))
    return int(bad[-1]) + 1 if len(bad) else 0


def forecasts(features: DataFrame, jobs: DataFrame, bounds: DataFrame, setting: K.Setting, study: Study, lanes: int = 8, method: str = "D") -> DataFrame:
    """Walk-forward forecasts of all jobs: features (series_id, t, value, sig, columns), bounds (series_id, tier, e0, e1).

    A detector is refitted every `study.every` months from the month before e0 and forecasts the months up to its next refit. Jobs of a series are dealt to `lanes` groups; the features are sent to each. A series
    or tier without evaluated months has none. A variable of which a series has no months leaves its models at class shares.
    """
    names = [c for c in features.columns if c not in ("series_id", "t", "month")]
    dealt = bounds.where("e1 >= e0").join(F.broadcast(jobs), "tier").withColumn("lane", F.pmod(F.xxhash64("tier", "detector"), F.lit(lanes)).cast("int"))  # the jobs of one study
    sent = features.select("series_id", "t", *names).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def run(key, rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        rows, out, memo = rows.sort_values("t"), [], {}
        value, sig = rows["value"].to_numpy(float), rows["sig"].to_numpy(float)
        columns = {c: rows[c].to_numpy(float) for c in names if c not in ("value", "sig")}
        if not len(rows):
            todo = todo.iloc[:0]
        for job in todo.itertuples():
            model, start = detector(job, study), first_month(columns, value, job.needs, study)
            for T in range(job.e0 - 1, job.e1, study.every):
                last = min(T + study.every, job.e1)
                v = Shared(value, sig, columns, setting, method, T, last, study.horizons, start)
                v.memo = memo
                for h, p in model.predict(v).items():
                    out.append(pd.DataFrame({"tier": job.tier, "detector": job.detector, "refit": T, "train_from": start, "t": v.months(), "h": h, "p_down": p[:, 0], "p_side": p[:, 1], "p_up": p[:, 2]}))
        got = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[c.split()[0] for c in FORECASTS.split(", ")][1:])
        got.insert(0, "series_id", key[0])
        return got.astype({"refit": "int32", "train_from": "int32", "t": "int32", "h": "int32"})

    # Both may come from one table. Their partitions are asked for by number, since ones of few bytes would be put together to a few long tasks.
    sent, dealt = (x.select(*[F.col(c).alias(c) for c in x.columns]).repartition(width(x.sparkSession), "series_id", "lane") for x in (sent, dealt))
    return sent.groupBy("series_id", "lane").cogroup(dealt.groupBy("series_id", "lane")).applyInPandas(run, FORECASTS)


def compared(made: DataFrame, truth: DataFrame, board: DataFrame, pairs: DataFrame, draws: int = 500, block: int = 24) -> DataFrame:
    """Each pair (tier, aug, base) on the same months of each series and horizon: SIDES of both as aug_x and base_x, differences as d_x, Diebold-Mariano on Brier scores, a block bootstrap of balanced accuracy, signed ranks of delays.

    made: forecasts; truth (series_id, t, truth, value) within the evaluated months; board: scores() of made.
    """
    shown = ["study", "var", "members", "label", "tier", "family", "aug", "base"]
    pairs = F.broadcast(pairs.select(*shown))  # of one study
    key = ["series_id", *shown, "h"]
    side = lambda table, name, columns: table.select("series_id", "tier", F.col("detector").alias(name), *columns)
    a = side(board, "aug", ["h", *[F.col(c).alias(f"aug_{c}") for c in C.SIDES]])
    b = side(board, "base", ["h", *[F.col(c).alias(f"base_{c}") for c in C.SIDES]])
    at = ["series_id", "tier", "base", "h"]
    sides = a.join(pairs, ["tier", "aug"]).join(b, at)
    rows = C.with_calls(made).withColumn("m", F.col("t") + F.col("h")).join(truth.select("series_id", F.col("t").alias("m"), "truth"), ["series_id", "m"])
    loss = sum((F.pow(F.col(p) - (F.col("truth") == k).cast("double"), 2) for k, p in C.CLASSES), F.lit(0.0))
    rows = rows.withColumn("loss", loss).where("loss is not null").select(*RUN, "h", "t", "truth", "call", "loss")
    x = rows.withColumnsRenamed({"detector": "aug", "call": "call_a", "loss": "loss_a"})
    y = rows.drop("truth").withColumnsRenamed({"detector": "base", "call": "call_b", "loss": "loss_b"})
    both = x.join(pairs, ["tier", "aug"]).join(y, [*at, "t"]).select(*key, "t", "truth", "call_a", "call_b", (F.col("loss_a") - F.col("loss_b")).alias("d"))
    series = both.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "d"))), lambda r: r["d"]).alias("d"))  # as long as a series
    mean, stat = C.dm_columns(F.col("d"), F.col("h"))
    dm = series.select(*key, mean.alias("dm_brier_diff"), stat.alias("stat"), F.size("d").alias("n"))
    dm = dm.select(*key, "dm_brier_diff", stats.p_of_t(F.col("stat"), (F.col("n") - 1).cast("double")).alias("p_dm"))
    ci = C.bootstrap(both.select(*key, "t", "truth", "call_a", "call_b"), key, draws, block)
    late = C.delays(made, truth, RUN)
    x = late.withColumnsRenamed({"detector": "aug", "delay": "delay_a"})
    y = late.withColumnsRenamed({"detector": "base", "delay": "delay_b"})
    ranks = x.join(pairs, ["tier", "aug"]).join(y, [*at, "event"]).where("delay_a is not null and delay_b is not null")
    ranks = ranks.groupBy(*key).agg(F.collect_list((F.col("delay_a") - F.col("delay_b")).cast("double")).alias("d")).select(*key, stats.p_of_ranks(F.col("d")).alias("p_wilcoxon_delay"))
    out = sides.join(dm, key, "left").join(ci, key, "left").join(ranks, key, "left")
    return out.select(*key, *[f"{s}_{c}" for s in ("aug", "base") for c in C.SIDES], *[(F.col(f"aug_{c}") - F.col(f"base_{c}")).alias(f"d_{c}") for c in C.DIFFERENCES], "dm_brier_diff", "p_dm", "ci_low", "ci_high", "p_boot", "p_wilcoxon_delay")


def events(truth: DataFrame, bounds: DataFrame, months: DataFrame) -> DataFrame:
    """(series_id, tier, start, end, dir, move_bp): the true trends that begin among a tier's evaluated months; the move from the month before to the end, in hundredths."""
    lanes = bounds.join(truth, "series_id").where("t <= e1").select("series_id", "tier", F.lit(0).alias("h"), "t", "truth", "value", "e0")
    keys = ("series_id", "tier")
    runs = W.runs(lanes, "truth", keys).where("truth <> 0").join(bounds, list(keys)).where("first >= e0 and first <= e1")
    at = lambda c, name: truth.select("series_id", F.col("t").alias(c), F.col("value").alias(name))
    day = lambda c, name: months.select("series_id", F.col("t").alias(c), F.date_format("month", "yyyy-MM").alias(name))
    runs = runs.withColumn("before", F.col("first") - 1).join(at("before", "y0"), ["series_id", "before"], "left").join(at("last", "y1"), ["series_id", "last"]).join(day("first", "start"), ["series_id", "first"]).join(day("last", "end"), ["series_id", "last"])
    return runs.select(*keys, "start", "end", F.col("truth").alias("dir"), F.bround(100 * (F.col("y1") - F.col("y0"))).cast("int").alias("move_bp"))


def spans(bounds: DataFrame, months: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, tier, e1, e0, eval_start, eval_end, n_events): the evaluated months of each tier and how many of the events `found` begin among them."""
    at = bounds.join(months.select("series_id", F.col("t").alias("e0"), F.date_format("month", "yyyy-MM").alias("eval_start")), ["series_id", "e0"]).join(months.select("series_id", F.col("t").alias("e1"), F.date_format("month", "yyyy-MM").alias("eval_end")), ["series_id", "e1"])
    return at.join(found.groupBy("series_id", "tier").count().withColumnRenamed("count", "n_events"), ["series_id", "tier"], "left").fillna(0, subset=["n_events"])


def paths(made: DataFrame, truth: DataFrame, months: DataFrame, tier: str, detectors: list[str], horizons: tuple[int, ...] = (0, 3)) -> DataFrame:
    """(series_id, month, value, truth, detector, h, p_down, p_side, p_up) of some models of a tier by the month of the forecast, rounded to 3 digits; truth is that month's."""
    rows = made.where((F.col("tier") == tier) & F.col("detector").isin(*detectors) & F.col("h").isin(*horizons))
    rows = rows.join(truth.select("series_id", "t", F.round("value", 3).alias("value"), "truth"), ["series_id", "t"]).join(months.select("series_id", "t", F.date_format("month", "yyyy-MM").alias("month")), ["series_id", "t"])
    return rows.select("series_id", "month", "value", "truth", "detector", "h", *[F.round(p, 3).alias(p) for p in C.PROBABILITIES])


def job_table(spark: SparkSession, jobs: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in JOB.split(", ")]
    return spark.createDataFrame([tuple(j[n] for n in names) for j in jobs], JOB)


def pair_table(spark: SparkSession, pairs: list[dict]) -> DataFrame:
    kind = "study string, var string, members array<string>, label string, tier string, family string, aug string, base string"
    return spark.createDataFrame([tuple(p[c.split()[0]] for c in kind.split(", ")) for p in pairs], kind)


def evaluated(truth: DataFrame, bounds: DataFrame) -> DataFrame:
    """The truth up to the last evaluated month of each series."""
    return truth.join(bounds.groupBy("series_id").agg(F.max("e1").alias("e1")), "series_id").where("t <= e1").drop("e1")


def scored(made: DataFrame, bounds: DataFrame, truth: DataFrame) -> DataFrame:
    """scores() of all forecasts of a study, written."""
    return written(C.scores(made.select(*RUN, "h", "t", *C.PROBABILITIES), evaluated(truth, bounds), RUN), "board")


KEPT_PATHS = ["Rule D (real time)", "Logit own", "MS own", "Logit all X", "Trees all X", "MS tvtp: momentum"]


def run(features: DataFrame, bounds: DataFrame, truth: DataFrame, months: DataFrame, setting: K.Setting, study: Study, draws: int = 500, lanes: int = 8, made: DataFrame | None = None, board: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a study: forecasts, leaderboard, add_one, leave_one_out, events, paths, tiers.

    features (series_id, t, value, sig, columns); bounds (series_id, tier, e0, e1); truth (series_id, t, truth, value); months (series_id, t, month). The forecasts are written once (or given as `made`), and so is the board (or given), which both comparisons read.
    """
    spark = features.sparkSession
    if made is None:
        made = written(forecasts(features, job_table(spark, all_jobs(study)), bounds, setting, study, lanes), "forecasts")
    known = evaluated(truth, bounds)
    board = scored(made, bounds, truth) if board is None else board
    pairs = pair_table(spark, all_pairs(study))
    starts = made.groupBy(*RUN).agg(F.min("train_from").alias("train_from"))
    ranked = F.broadcast(spark.createDataFrame([(j["tier"], j["detector"]) for j in boards(study)], "tier string, detector string"))  # ten a tier
    both = compared(made, known, board, pairs, draws)
    found = events(known, bounds, months)
    return {
        "forecasts": made, "leaderboard": board.join(ranked, ["tier", "detector"]).join(starts, RUN), "add_one": both.where("study = 'add_one'").drop("study"), "leave_one_out": both.where("study = 'leave_one_out'").drop("study", "members", "family"),
        "events": found, "paths": paths(made, known, months, next(iter(study.tiers)), KEPT_PATHS), "tiers": spans(bounds, months, found),
    }


MATCHED = {
    "bal_acc": "aug_bal_acc", "bal_acc_base": "base_bal_acc", "d_bal_acc": "d_bal_acc", "bss": "aug_bss", "d_bss": "d_bss", "p_dm": "p_dm", "delay": "aug_delay_med", "d_delay": "d_delay_med", "p_delay": "p_wilcoxon_delay",
    "false_alarms_10y": "aug_false_alarms_10y", "d_false_alarms": "d_false_alarms_10y", "d_pnl_bp_yr": "d_pnl_bp_yr",
}


def matched_test(features: DataFrame, bounds: DataFrame, truth: DataFrame, months: DataFrame, setting: K.Setting, study: Study, models: tuple[str, ...] = ("logit", "ms-tvtp"), draws: int = 500, lanes: int = 8) -> DataFrame:
    """(series_id, var, model, h, train_from, scores and differences): one row for each variable, model and horizon, see MATCHED. A model without a first month of its own has none."""
    spark = features.sparkSession
    jobs, pairs = matched(study, models)
    made = written(forecasts(features, job_table(spark, jobs), bounds, setting, study, lanes), "forecasts")
    both = compared(made, evaluated(truth, bounds), scored(made, bounds, truth), pair_table(spark, pairs), draws)
    starts = made.select("series_id", "tier", F.col("detector").alias("aug"), F.col("train_from").alias("t")).distinct().join(months.select("series_id", "t", F.date_format("month", "yyyy-MM").alias("train_from")), ["series_id", "t"]).drop("t")
    out = both.join(starts, ["series_id", "tier", "aug"], "left").withColumn("train_from", F.when(F.col("family") != "rule", F.col("train_from")))
    return out.select("series_id", "var", F.col("family").alias("model"), "h", "train_from", *[F.col(c).alias(n) for n, c in MATCHED.items()])


# ---- features of a panel

OWN = ("d1", "d3", "d6", "d12", "dd12", "ru12", "gap12", "vol12", "z3", "z12", "ddz", "ruz", "rt_up", "rt_down", "rt_age")
PARTS = {"": "value", "_z3": "z3", "_z12": "z12", "_up": "up", "_down": "down"}


def panel_features(series: DataFrame, live_labels: DataFrame, levels: DataFrame, variables: dict[str, Variable]) -> DataFrame:
    """(series_id, t, month, value, sig, own features, and of each variable its level and compact features): series has sig, live_labels are its real-time labels of method D, levels (series_id, month, value) the variables as they were known.

    A variable without rows has null columns. The variables of a month are one row, which all series of the month share.
    """
    own = P.own_features(series, live_labels)
    x = P.x_features(levels, levels.select("month", F.lit(None).cast("double").alias("value")).distinct(), P.trend_state(levels), (), ())
    wide = x.groupBy("month").pivot("series_id", list(variables)).agg(*[F.first(c).alias(f"x{k}") for k, c in PARTS.items()])
    wide = wide.select("month", *[F.col(f"{n}_x{k}").alias(f"{n}{k}") for n in variables for k in PARTS])
    return own.join(wide, "month", "left").withColumns({f"{n}_spr": F.col("value") - F.col(n) for n, v in variables.items() if v.spread} or {"month": F.col("month")})


# ---- findings


def findings(comparisons: DataFrame, board: DataFrame, level: float = 0.1, top: int = 3) -> DataFrame:
    """(finding, series_id, tier, what, value, p): what a reader of the study looks for, read off its tables at horizon 0.

    best_model: of each tier by Brier skill; gain: candidates with significantly lower Brier scores, most certain first, `top` a series; earlier: those with the largest cut of the median delay without more false alarms; share_helping: the share of
    candidates that raise skill at all; count_significant: how many do so significantly, by family.
    """
    b, c = board.where("h = 0"), comparisons.where("h = 0")
    name = F.concat_ws(" ", "family", "var")
    best = b.where("bss is not null").groupBy("series_id", "tier").agg(F.max_by("detector", F.struct("bss", "detector")).alias("what"), F.max("bss").alias("value")).select(F.lit("best_model").alias("finding"), "series_id", "tier", "what", "value", F.lit(None).cast("double").alias("p"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("series_id").orderBy(*order, "family", "var"))
    gain = c.where((F.col("p_dm") < level) & (F.col("d_brier") < 0)).withColumn("n", nth(F.col("p_dm"))).where(F.col("n") <= top).select(F.lit("gain").alias("finding"), "series_id", "tier", name.alias("what"), F.col("d_bss").alias("value"), F.col("p_dm").alias("p"))
    early = c.where("d_delay_med < 0 and d_false_alarms_10y <= 0").withColumn("n", nth(F.col("d_delay_med"))).where(F.col("n") <= top).select(F.lit("earlier").alias("finding"), "series_id", "tier", name.alias("what"), F.col("d_delay_med").cast("double").alias("value"), F.col("p_wilcoxon_delay").alias("p"))
    helping = c.groupBy("series_id", "tier").agg(F.avg((F.col("d_bss") > 0).cast("double")).alias("value")).select(F.lit("share_helping").alias("finding"), "series_id", "tier", F.lit("all candidates").alias("what"), "value", F.lit(None).cast("double").alias("p"))
    counts = c.groupBy("series_id", "tier", "family").agg(F.count_if((F.col("p_dm") < level) & (F.col("d_brier") < 0)).cast("double").alias("value")).select(F.lit("count_significant").alias("finding"), "series_id", "tier", F.col("family").alias("what"), "value", F.lit(None).cast("double").alias("p"))
    return best.unionByName(gain).unionByName(early).unionByName(helping).unionByName(counts)
