"""Running results over streams of triples and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import KEY


def relation_counts(stream: DataFrame) -> DataFrame:
    """Triples per relation so far; for complete or update mode."""
    return stream.groupBy("r").agg(F.count("*").alias("count"))


def first_seen(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Each triple once, as long as its copies are no later than ``delay``; state older than that goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEY)


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Triples per relation and window of time; for append mode."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), "r").agg(F.count("*").alias("count"))


def running_ranks(stream: DataFrame, true: DataFrame) -> DataFrame:
    """Ranks of true scores (query, true) while candidates (query, score) arrive: counts of greater and equal ones so far."""
    scored = stream.join(true, "query")
    counts = scored.groupBy("query").agg(F.count(F.when(F.col("score") > F.col("true"), 1)).alias("above"), F.count(F.when(F.col("score") >= F.col("true"), 1)).alias("not_below"), F.count("*").alias("options"))
    return counts.select("query", (F.col("above") + 1).alias("optimistic"), (F.col("not_below") + 1).alias("pessimistic"), ((F.col("above") + F.col("not_below") + 2) / 2).alias("realistic"), "options")
