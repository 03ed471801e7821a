"""Incremental counts over a stream of cells: how many columns hold a value, and how many hold two values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.text import is_noise_value


def stream_value_counts(columns: DataFrame) -> DataFrame:
    """(value, n_cols) in update mode, for a stream of columns (table_idx, col_idx, vals) that each arrive once."""
    vals = F.array_distinct(F.filter("vals", lambda v: v.isNotNull() & (v != "") & ~is_noise_value(v)))
    rows = columns.select(vals.alias("vals")).where(F.size("vals") >= 2)
    return rows.select(F.explode("vals").alias("value")).groupBy("value").agg(F.count("*").alias("n_cols"))


def stream_pairs(columns: DataFrame) -> DataFrame:
    """(u, v, n) in update mode."""
    vals = F.array_sort(F.array_distinct(F.filter("vals", lambda v: v.isNotNull() & (v != "") & ~is_noise_value(v))))
    first = columns.select(vals.alias("vals")).select("vals", F.posexplode("vals").alias("i", "u"))
    return first.select("u", F.explode(F.expr("slice(vals, i + 2, size(vals))")).alias("v")).groupBy("u", "v").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, key, n, total) with a watermark, for append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
