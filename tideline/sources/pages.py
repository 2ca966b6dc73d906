"""Pages as a data source that is written at once: one file a row, all of them or none.

Tasks write into a staging folder beside the target, which must be on a file system that all machines share (a path or an address that Arrow's file systems know). Only when every task has ended does the driver move
the files to their names; if a task fails for good, the staging folder goes and nothing else has changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]
    staged: tuple[str, ...]


class PageWriter(DataSourceWriter):
    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite, self.staging = path.rstrip("/"), ending, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = _system(self.path)
        system.create_dir(f"{base}/{self.staging}", recursive=True)
        names, staged = [], []
        for r in rows:
            if r["name"] is None or "/" in r["name"] or r["name"].startswith("_"):
                raise ValueError(f"a page can't be named {r['name']!r}")
            file = f"{self.staging}/{uuid.uuid4().hex}"  # a task that runs again writes other files
            with system.open_output_stream(f"{base}/{file}") as out:
                out.write((r["text"] or "").encode())
            names.append(r["name"] + self.ending)
            staged.append(file)
        return Written(tuple(names), tuple(staged))

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, base = _system(self.path)
        pages = [(n, f) for m in messages if m is not None for n, f in zip(m.names, m.staged)]
        names = [n for n, _ in pages]
        there = [n for n in set(names) if system.get_file_info(f"{base}/{n}").type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"pages of one name, or that are there already: {sorted(there or {n for n in names if names.count(n) > 1})[:5]}")
        for name, file in pages:
            system.move(f"{base}/{file}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        """The staging folder goes, with what is left in it."""
        from pyarrow import fs

        system, base = _system(self.path)
        if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.staging}")


class Pages(DataSource):
    """df.write.format("tideline_pages").option("path", folder).mode("append").save() for rows (name, text). Options: `ending` of the files' names (.html). With mode overwrite, pages of the same names are replaced; others stay."""

    @classmethod
    def name(cls) -> str:
        return "tideline_pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options.get("ending", ".html"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


def pages(series: DataFrame, template: str, title: str = "Trend states of {series}") -> DataFrame:
    """(name, text): a page for each series (series_id, month, value): the template with {{title}}, {{series}} and {{data}}, dates and values to 6 digits as JSON, filled in."""
    rows = series.where("value is not null").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("month", F.round("value", 6).alias("y")))).alias("r"))
    data = F.to_json(F.struct(F.transform("r", lambda x: F.date_format(x["month"], "yyyy-MM-dd")).alias("dates"), F.transform("r", lambda x: x["y"]).alias("y")))
    text = F.lit(template)
    for place, value in (("{{title}}", F.replace(F.lit(title), F.lit("{series}"), F.col("series_id"))), ("{{series}}", F.col("series_id")), ("{{data}}", data)):
        text = F.replace(text, F.lit(place), value)
    return rows.select(F.col("series_id").alias("name"), text.alias("text"))


def reports(findings: DataFrame, template: str) -> DataFrame:
    """(name, text): a report for each series of a study's findings: the template with {{series}} and {{findings}}, the rows as JSON in order, filled in."""
    row = F.struct("finding", "tier", "what", F.round("value", 5).alias("value"), F.round("p", 5).alias("p"))
    rows = findings.groupBy("series_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
    return rows.select(F.col("series_id").alias("name"), F.replace(F.replace(F.lit(template), F.lit("{{series}}"), F.col("series_id")), F.lit("{{findings}}"), F.col("json")).alias("text"))
