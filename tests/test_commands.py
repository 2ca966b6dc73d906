"""Commands and sinks on small files."""

import numpy as np
from pyspark.sql import functions as F

import tideline
from tideline import cli
from tideline.sources import series as S


def panel_files(folder, n=150):
    draw, months = np.random.default_rng(9), [f"{1985 + k // 12}-{k % 12 + 1:02d}-01" for k in range(n)]
    cols = {c: np.cumsum(draw.normal(0, 0.4, n)).round(4) for c in ("y10", "a", "b")}
    (folder / "panel.csv").write_text("date,y10,a,b\n" + "".join(f"{m},{cols['y10'][k]},{cols['a'][k]},{cols['b'][k] if k > 20 else ''}\n" for k, m in enumerate(months)))
    (folder / "meta.csv").write_text("id,name,group,kind,pub_lag\ny10,Ten,target,rate,0\na,Alpha,x,rate,1\nb,Beta,x,price,0\n")
    (folder / "user.csv").write_text("when,u\n" + "".join(f"{m[:8]}17,{v}\n" for m, v in zip(months, np.cumsum(draw.normal(0, 0.4, n)).round(4))))
    (folder / "user_meta.csv").write_text("id,kind,pub_lag,name\nu,rate,0,Mine\n")
    return [f"file://{folder / f}" for f in ("panel.csv", "meta.csv", "user.csv", "user_meta.csv")]


def test_matched_command(spark, tmp_path):
    panel, meta, user, user_meta = panel_files(tmp_path)
    out = f"file://{tmp_path}/matched"
    cli.main(["matched", panel, meta, "--vars", "a", "u", "--models", "logit", "rule", "--horizons", "0", "3", "--eval-start", "1991-01-01", "--settings", "fixed100", "--add-csv", user, "--add-meta", user_meta, "--draws", "20", "--out", out])
    rows = spark.read.option("header", True).option("inferSchema", True).csv(out)
    assert rows.columns == ["series_id", "var", "model", "h", "train_from", *cli.X.MATCHED]
    got = {(r["var"], r["model"], r["h"]): r for r in rows.collect()}
    assert set(got) == {(v, m, h) for v in "au" for m in ("logit", "rule") for h in (0, 3)}
    assert all(r["train_from"] is None for k, r in got.items() if k[1] == "rule") and all(r["train_from"] is not None for k, r in got.items() if k[1] == "logit")
    assert all(abs(r["bal_acc"] - r["bal_acc_base"] - r["d_bal_acc"]) < 1e-9 for r in got.values())
    cli.main(["matched", panel, meta, "--list"])


def test_page_command(spark, tmp_path):
    panel_files(tmp_path, 30)
    (tmp_path / "t.html").write_text("<title>{{title}}</title><i>{{series}} {{short}}</i><script>{{data}}</script>")
    cli.main(["page", f"file://{tmp_path}/panel.csv", str(tmp_path / "t.html"), "--date-col", "date", "--value-col", "y10", "--series", "Ten years", "--short", "tens", "--title", "T", "--out", str(tmp_path / "p.html")])
    html = (tmp_path / "p.html").read_text()
    assert html.startswith('<title>T</title><i>Ten years tens</i><script>{"dates":["1985-01-01","1985-02-01"') and '"y":[' in html


def test_panel_writer(spark, tmp_path):
    panel, meta = S.load_panel(spark, *panel_files(tmp_path, 40)[:2])
    S.write_panel(panel.withColumn("value", F.col("value") + 1e-9), meta, f"file://{tmp_path}/out", ["y10", "b"])
    again, meta2 = S.load_panel(spark, f"file://{tmp_path}/out/monthly", f"file://{tmp_path}/out/meta")
    pick = lambda df: sorted((r["series_id"], r["month"], round(r["value"], 6)) for r in df.where("value is not null and series_id <> 'a'").collect())
    assert pick(again) == pick(panel)
    assert {r["id"]: (r["start"], r["end"], r["n"], r["kind"]) for r in meta2.collect()} == {"y10": ("1985-01", "1988-04", "40", "rate"), "b": ("1986-10", "1988-04", "19", "price")}


def test_exports():
    assert all(hasattr(tideline, n) for n in tideline.__all__) and len(tideline.__all__) >= 18
