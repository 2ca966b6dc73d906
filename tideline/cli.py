"""Commands.

python -m tideline.cli label DATA.csv: labels a two-column CSV by all methods, writes labels and segments, and prints where the series stands.
python -m tideline.cli matched PANEL.csv META.csv --target ID --vars A B: tests whether variables help to tell the target's state in real time, each against the same model without it.
python -m tideline.cli page DATA.csv TEMPLATE.html: fills a page's template with a series.
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import webbrowser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import rule as R
from tideline.operators import kernels as K
from tideline.operators import labelers as L
from tideline.operators import matrix as X
from tideline.operators import panel as P
from tideline.operators import walkforward as G
from tideline.operators.tables import written
from tideline.sources import series as S

METHODS = ["A", "B", "D", "E", "F", "G", "A_rt", "C", "D_rt", "E_rt", "F_rt"]
SETTINGS = {"default": R.DEFAULT, "fixed100": R.FIXED100}
#: The series of which momentum is made, and their signs.
MOMENTUM = {"payems": 1, "core_cpi": 1, "y2": 1, "spx": 1, "usd": -1}


def label(spark: SparkSession, path: str, out: str, date_col: str, value_col: str, setting: dict) -> None:
    series = S.numbered(S.read_csv(spark, path, date_col, value_col))
    settings = R.settings(spark, setting)
    labels = L.machine_labels(series, settings).unionByName(L.method_c(series, settings)).cache()
    S.write_labels(labels.join(series.select("series_id", "t", "month"), ["series_id", "t"]), METHODS, f"{out}/labels")
    S.write_segments(L.decorated(L.machine_segments(series, settings), series, settings), f"{out}/segments")
    S.cadence(series).where("too_frequent").select(F.lit("rows are less than a month apart").alias("warning")).show(truncate=False)
    L.in_state_since(labels).orderBy("method").show()
    L.agreement(labels).where("a = 'D'").select("b", "agree", "kappa").orderBy("b").show()


def with_user_csv(spark: SparkSession, panel: DataFrame, meta: DataFrame, csv: str, meta_csv: str) -> tuple[DataFrame, DataFrame]:
    """The panel with the series of a user's wide CSV, whose first column is the date, and its metadata."""
    first = spark.read.option("header", True).csv(csv).columns[0]
    user, user_meta = S.load_panel(spark, csv, meta_csv, first)
    return S.with_user_series(panel, user, meta, user_meta)


def matched(spark: SparkSession, panel: DataFrame, meta: DataFrame, target: str, names: list[str], models: list[str], horizons: list[int], start: str, setting: dict, draws: int, least: int = 48) -> DataFrame:
    """The table of a matched test of `names` on the series `target` of a panel (series_id, month, value) with its metadata. `mm`, momentum, can be named where its parts are in the panel; a name that isn't there is an error."""
    known = {r["id"]: r for r in meta.where(F.col("id").isin(*names)).collect()}
    missing = [n for n in names if n not in known and n != "mm"]
    if missing:
        raise ValueError(f"not in the panel: {', '.join(missing)}")
    live = P.realtime(panel, meta)
    levels = P.level(live, meta)
    if "mm" in names:
        levels = levels.unionByName(P.macro_momentum(levels, MOMENTUM).select(F.lit("mm").alias("series_id"), "month", "value"))
    levels = written(levels.where(F.col("series_id").isin(*names)), "levels")
    settings = R.settings(spark, setting)
    series = written(S.numbered(panel.where(F.col("series_id") == target)), "target")
    segments = L.machine_segments(series, settings, ("D",))
    ends = L.settled_end(segments, series.groupBy("series_id").agg(F.count("*").alias("n")))
    bounds = written(G.bounds(series, ends, start).select("series_id", F.lit("T").alias("tier"), "e0", "e1"), "bounds")
    truth = written(L.machine_labels(series, settings, ("D",)).select("series_id", "t", F.col("label").alias("truth")).join(series.select("series_id", "t", "value"), ["series_id", "t"]), "truth")
    variables = {n: X.Variable("T", n if n == "mm" else known[n]["name"], n == "mm" or known[n]["kind"] == "rate", n in P.SPREAD_VARS) for n in names}
    study = X.Study(variables, {}, {"T": start}, X.OWN, "mm", tuple(horizons), options={"logit": {"least": least}, "boosted": {"least": least}})
    live_d = L.machine_labels(series, settings, ("D_rt",)).select("series_id", "t", "label")
    features = written(X.panel_features(L.with_sigma(series), live_d, levels, variables), "features")
    kernel = K.Setting(**{f: setting[f] for f in L.SETTING if f in setting})
    return X.matched_test(features, bounds, truth, series, kernel, study, tuple(models), draws)


def page(spark: SparkSession, path: str, template: str, out: str, date_col: str, value_col: str, series: str, short: str, title: str) -> str:
    """Writes a page: the template with {{title}}, {{series}}, {{short}} and {{data}} filled in. Gives its address."""
    rows = S.read_csv(spark, path, date_col, value_col)
    S.cadence(rows).where("too_frequent").select(F.lit("rows are less than a month apart").alias("warning")).show(truncate=False)
    html = S.page(pathlib.Path(template).read_text(encoding="utf-8"), title, {"series": series, "short": short, "data": S.page_data(rows)})
    file = pathlib.Path(out).resolve()
    file.write_text(html, encoding="utf-8")
    return file.as_uri()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("label")
    a.add_argument("path")
    a.add_argument("--out", default="out")
    a.add_argument("--date-col", default="Date")
    a.add_argument("--value-col", default="Rate")
    a.add_argument("--fixed", action="store_true", help="a fixed required move instead of one scaled by volatility")
    a.add_argument("--thr", type=float, default=1.0)
    m = sub.add_parser("matched")
    m.add_argument("panel")
    m.add_argument("meta")
    m.add_argument("--target", default="y10")
    m.add_argument("--vars", nargs="*", default=[])
    m.add_argument("--models", nargs="*", default=["logit", "ms-tvtp"], choices=list(X.MODELS))
    m.add_argument("--horizons", nargs="*", type=int, default=[0, 3])
    m.add_argument("--eval-start", default="1990-01-01")
    m.add_argument("--settings", default="default", choices=list(SETTINGS))
    m.add_argument("--add-csv")
    m.add_argument("--add-meta")
    m.add_argument("--draws", type=int, default=500, help="bootstrap draws")
    m.add_argument("--least", type=int, default=48, help="months that a model needs to learn from")
    m.add_argument("--out", default="matched")
    m.add_argument("--list", action="store_true", help="the variables in the panel")
    g = sub.add_parser("page")
    g.add_argument("path")
    g.add_argument("template")
    for name, default in (("--date-col", "Date"), ("--value-col", "Rate"), ("--series", "Series"), ("--short", "series"), ("--title", "Trend states"), ("--out", "page.html")):
        g.add_argument(name, default=default)
    g.add_argument("--open", action="store_true", help="show the page in a browser")
    o = p.parse_args(args)
    if o.command == "matched" and not o.list and not o.vars:
        sys.exit("give --vars (see --list)")
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    if o.command == "label":
        label(spark, o.path, o.out, o.date_col, o.value_col, (R.FIXED100 if o.fixed else R.DEFAULT) | {"thr": o.thr})
    elif o.command == "page":
        address = page(spark, o.path, o.template, o.out, o.date_col, o.value_col, o.series, o.short, o.title)
        print(f"wrote {address}")
        if o.open:
            webbrowser.open(address)
    else:
        panel, meta = S.load_panel(spark, o.panel, o.meta)
        if o.add_csv:
            panel, meta = with_user_csv(spark, panel, meta, o.add_csv, o.add_meta)
        if o.list:
            S.summary(panel, meta).orderBy("group", "series_id").select("series_id", "name", "group", "kind", "pub_lag", "start", "end", "n").show(1000, truncate=False)
            return
        rows = written(matched(spark, panel, meta, o.target, o.vars, o.models, o.horizons, o.eval_start, SETTINGS[o.settings], o.draws, o.least), "matched")
        S.write_comparison(rows, o.out)
        rows.orderBy("var", "model", "h").select(*[F.round(c, 3).alias(c) if k == "double" else c for c, k in rows.dtypes]).show(1000, truncate=False)
        print(f"wrote {o.out}. d_*: with the variable minus without; p_dm: Diebold-Mariano on Brier scores; p_delay: signed ranks of delays.")


if __name__ == "__main__":
    main()
