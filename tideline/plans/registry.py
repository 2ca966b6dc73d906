"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import labelers as L
from tideline.plans import label_queries, machine_sql, matrix_queries, series_queries, stream_queries, study_queries
from tideline.plans.base import FIXED, grid, walk

QUERIES: dict = {**series_queries.Q, **label_queries.Q, **study_queries.Q, **matrix_queries.Q, **stream_queries.Q}
ORACLE_SQL: dict[str, str] = {**series_queries.SQL, **label_queries.SQL, **study_queries.SQL, **matrix_queries.SQL, **stream_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each return flag: its trend state by method D, since when, and the move required over the segment so far."""
    series, settings = walk(spark, sf_dir), grid(spark, FIXED)
    last = L.latest(L.machine_segments(series, settings, ("D",)))
    return L.decorated(last, series, settings).select("series_id", "label", "start_date", "end_date", "months", "y0", "y1", "chg_bp", F.round("score", 6).alias("score"), "req_bp")


QUERIES["flagship_current_state"] = flagship
ORACLE_SQL["flagship_current_state"] = machine_sql.flagship_sql(FIXED)
__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
