"""Table functions for SQL: the segments of a series as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tideline.operators import kernels as K

SEGMENT = "method string, seg_no int, start int, end int, label int, confirm int, open boolean, imp double"


class Segments:
    """segments(values, sigma, methods, thr, scaled, z, min_len): the segments of one series by each method of a comma-separated list (A, B, D, E, F, G). Null or empty arrays, and a null list, have none."""

    def eval(self, values: list, sigma: list, methods: str, thr: float, scaled: bool, z: float, min_len: int) -> Iterator[tuple]:
        if not values or not methods:
            return
        setting = K.Setting(thr=float(thr), scaled=bool(scaled), z=float(z), min_len=int(min_len))
        y = np.array(values, dtype=float)
        sig = np.array([np.nan] * len(y) if sigma is None else sigma, dtype=float)
        for method, found in K.label_all(y, setting, sig, tuple(m.strip() for m in methods.split(",")))[1].items():
            for k, g in enumerate(found):
                yield method, k, int(g.start), int(g.end), int(g.label), None if g.confirm is None else int(g.confirm), g.open, None if g.imp is None else float(g.imp)


def register(spark: SparkSession) -> None:
    """Makes segments() known to the session's SQL: SELECT s.series_id, g.* FROM s, LATERAL segments(s.ys, s.sg, 'A,D', 1.0, false, 2.0, 0) AS g."""
    spark.udtf.register("segments", udtf(Segments, returnType=SEGMENT, useArrow=True))
