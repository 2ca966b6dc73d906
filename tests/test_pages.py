"""Pages are written all or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tideline.plans.base import walk
from tideline.sources import pages


def test_pages_of_all_series(spark, sf, tmp_path):
    pages.register(spark)
    rows = pages.pages(walk(spark, sf), "<title>{{title}}</title>{{data}}").repartition(3)
    write = lambda mode, df=rows: df.write.format("tideline_pages").option("path", f"file://{tmp_path}/out").mode(mode).save()
    write("append")
    assert sorted(os.listdir(tmp_path / "out")) == ["A.html", "N.html", "R.html"]
    text = (tmp_path / "out" / "A.html").read_text()
    assert text.startswith("<title>Trend states of A</title>") and len(json.loads(text.split("</title>")[1])["y"]) == 82
    with pytest.raises(Exception, match="there already"):
        write("append", rows.withColumn("text", F.lit("new")))
    assert (tmp_path / "out" / "A.html").read_text() == text
    write("overwrite", rows.where("name = 'A'").withColumn("text", F.lit("new")))
    assert sorted(os.listdir(tmp_path / "out")) == ["A.html", "N.html", "R.html"] and (tmp_path / "out" / "A.html").read_text() == "new"


@pytest.mark.parametrize("bad", ["a/b", None])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    pages.register(spark)
    rows = spark.createDataFrame([(f"p{k}", "x") for k in range(50)] + [(bad, "x")], "name string, text string").repartition(6)
    with pytest.raises(Exception, match="can't be named"):
        rows.write.format("tideline_pages").option("path", f"{tmp_path}/out").mode("append").save()
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_reports(spark, tmp_path):
    pages.register(spark)
    rows = spark.createDataFrame([("A", "gain", "L", "Logit n1", 0.1234567, 0.04), ("A", "best_model", "L", "MS own", 0.2, None), ("B", "gain", "M", "x", 1.0, 0.01)], "series_id string, finding string, tier string, what string, value double, p double")
    pages.reports(rows, "{{series}}: {{findings}}").write.format("tideline_pages").option("path", str(tmp_path)).option("ending", ".txt").mode("append").save()
    name, found = (tmp_path / "A.txt").read_text().split(": ", 1)
    assert name == "A" and [f["finding"] for f in json.loads(found)] == ["best_model", "gain"] and json.loads(found)[1]["value"] == 0.12346
