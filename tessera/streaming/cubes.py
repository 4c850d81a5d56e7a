"""Cubes from streams: windowed cells with a watermark, and an online detector of level shifts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_cells(events: DataFrame, keys: dict[str, Column], value: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Cells of a stream: counts and means by keys and tumbling window; rows later than the watermark are left out."""
    stamped = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    cells = stamped.groupBy(F.window("__ts", width), *[c.alias(k) for k, c in keys.items()]).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return cells.select(F.col("window.start").alias("start"), *keys, "mean", "n")


def level_shifts(cells: DataFrame, key: str, value: str, limit: float = 4.0) -> DataFrame:
    """(key, seen, value): values that lie `limit` deviations from what the key has had; state is three sums a key."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, q = state.get if state.exists else (0, 0.0, 0.0)
        out: list[dict[str, Any]] = []
        for part in parts:
            for v in part[value].dropna():
                mean = s / n if n else 0.0
                spread = max(q / n - mean * mean, 0.0) ** 0.5 if n else 0.0
                if n >= 8 and abs(v - mean) > limit * max(spread, 1e-12):
                    out.append({key: k[0], "seen": n, "value": float(v)})
                n, s, q = n + 1, s + float(v), q + float(v) ** 2
        state.update((n, s, q))
        yield pd.DataFrame(out, columns=[key, "seen", "value"])

    kind = dict(cells.dtypes)[key]
    return cells.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seen long, value double", "n long, s double, q double", "append", GroupStateTimeout.NoTimeout)
