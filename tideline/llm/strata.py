"""Ranks of rows within strata in a seeded order, dealt over many tasks however large a stratum is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.shared import cut


def with_key(docs: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Adds `stratum` (a null source is a stratum of its own, ahead of the others) and `key`, a seeded digest of the id that shuffles rows."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    return docs.withColumn("stratum", stratum).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")))


def ranked(rows: DataFrame, total: int, ties: list[str]) -> DataFrame:
    """Adds `rank` (from 0) and `size` of the row's stratum, by key and then `ties`.

    Keys are random, so the groups of a stratum's rows with the same leading digits are about equal and none is large; their counts, a few for each
    stratum, give where each group starts. The number of digits changes nothing but the size of groups.
    """
    digits = 1 if total < 20_000 else 2 if total < 50_000_000 else 3 if total < 10**10 else 4
    rows = rows.withColumn("lead", F.substring("key", 1, digits))
    counts = rows.groupBy("stratum", "lead").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    starts = counts.select("stratum", "lead", (F.sum("n").over(w.orderBy("lead")) - F.col("n")).alias("start"), F.sum("n").over(w).alias("stratum_rows"))
    own = Window.partitionBy("stratum", "lead").orderBy("key", *ties)
    numbered = rows.withColumn("rn", F.row_number().over(own))
    return numbered.join(starts, ["stratum", "lead"]).withColumn("rank", F.col("start") + F.col("rn") - 1).drop("lead", "rn", "start")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds n = 1, 2, .. among the rows of a key, for rows of (key, lead, at, ..), none of these null and `at` unique in its key: by lead, then by at. Only rows equal in key and lead meet in a task."""
    counts = rows.groupBy("key", "lead").agg(F.count("*").alias("held"))
    before = counts.select("key", "lead", (F.sum("held").over(Window.partitionBy("key").orderBy("lead")) - F.col("held")).alias("before"))
    own = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key", "lead").orderBy("at")))
    return own.join(before, ["key", "lead"]).withColumn("n", F.col("before") + F.col("rn")).drop("rn", "before", "lead")


def handed_out(docs: DataFrame, key, places: DataFrame) -> DataFrame:
    """(row, columns of `places`): each row of `docs`, as a struct, with a place of its own out of `places` (key, lead, at, ..), which has as many rows of each key as docs has.

    Where keys repeat, a third of all rows may have none: such rows are numbered without their columns, in pieces by where they stand and by `lead`, and meet their place by number. Whole rows are then written once more and shuffled once."""
    if places.groupBy("key").count().where("count > 1").isEmpty():
        return docs.select(F.struct("*").alias("row"), key.alias("key")).join(places, "key").drop("key", "lead")
    kept = cut(docs.select(F.struct("*").alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("mine")), "kept")  # written, so that numbers of rows stay
    left = numbered(kept.select("key", F.shiftright("mine", 33).alias("lead"), F.col("mine").alias("at"))).withColumnRenamed("at", "mine")
    return kept.drop("key").join(left.join(numbered(places), ["key", "n"]).drop("key", "n"), "mine").drop("mine")
