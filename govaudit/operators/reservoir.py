"""Weighted samples of exact size per stratum, without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waiting_time(weight: Column, key: Column, seed: str) -> Column:
    """An exponential waiting time of rate ``weight``, drawn from 52 bits of the key's hash."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return -F.log((head + 0.5) / float(1 << 52)) / weight


def weighted_reservoir(rows: DataFrame, strata: list[str], weight: Column, k: int, key: str, seed: str) -> DataFrame:
    """``k`` rows per stratum (all, if it has fewer) and their ``place``, as if drawn one after the other by weight.

    The k smallest waiting times have that distribution. Which rows these are
    depends on key, weight and seed alone, so a lost task draws the same again.
    Spark keeps k rows per stratum and task before the shuffle; what meets in
    one task is k rows of each task, whatever the stratum's size.

    Rows whose weight is null, 0 or less are never drawn; rows without key wait
    the same time; ties go by key. ``key`` is to be unique, or its copies are
    drawn next to each other.
    """
    order = Window.partitionBy(*strata).orderBy("_wait", key)
    drawn = rows.withColumn("_weight", weight).where("_weight > 0").withColumn("_wait", waiting_time(F.col("_weight"), F.col(key), seed))
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_weight", "_wait")
