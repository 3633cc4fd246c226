"""Streaming forms of the day, window, duplicate and memory operators over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_stream(spark, path: str, schema):
    """Parquet files of messages as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(edges: DataFrame, late: str = "1 day") -> DataFrame:
    """Day slices of (ts, src, dst): closed once the watermark passes."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "src", "dst").agg(F.count("*").alias("w")).select(F.to_date("window.start").alias("day"), "src", "dst", "w")


def sliding(edges: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    return edges.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), "src", "dst").agg(F.count("*").alias("w")).select(F.col("window.end").alias("until"), "src", "dst", "w")


def sessions(edges: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return edges.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "src").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("begin"), "src", "n")


def deduplicate(msgs: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of the same second, sender, recipients and cc once, while the watermark lasts."""
    keyed = msgs.withColumn("second", F.date_trunc("second", "ts")).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["second", "sender", "recipients", "cc"]).drop("second")


def fading_memory(edges: DataFrame, gamma: float = 0.5, tol: float = 1e-3) -> DataFrame:
    """(src, dst, day, f): per pair, f decays by gamma a calendar day since the last and takes the new weight; state is two numbers a pair.

    A day that comes late, before the last one of its pair, adds its weight as it has decayed since, so that f at the last day is what it
    would have been in order (but for what was forgotten meanwhile), and that day's row comes again. The batch operator
    with ``calendar`` gives the same numbers."""

    def fold(key, frames: Iterator[pd.DataFrame], state):
        f, last = state.get if state.exists else (0.0, None)
        days: dict = {}
        for frame in frames:
            for day, w in zip(frame["day"], frame["w"], strict=True):
                at = pd.Timestamp(day).toordinal()
                days[at] = days.get(at, 0.0) + w
        rows = []
        for at in sorted(days):
            if last is not None and at <= last:
                f += days[at] * gamma ** (last - at)
            else:
                f = f * gamma ** (at - last) + days[at] if last is not None else days[at]
                last = at
            f = f if abs(f) > tol else 0.0
            rows.append((key[0], key[1], pd.Timestamp.fromordinal(last).date(), f))
        state.update((f, last))
        yield pd.DataFrame(rows, columns=["src", "dst", "day", "f"])

    return edges.groupBy("src", "dst").applyInPandasWithState(fold, "src long, dst long, day date, f double", "f double, last long", "append", "NoTimeout")
