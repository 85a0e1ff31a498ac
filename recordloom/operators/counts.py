"""Counts over visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.text import round_half_even


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, most frequent first; ties by value."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(column))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return value_counts(df, column).limit(k)


def counts_by_key(df: DataFrame, column: str) -> DataFrame:
    """Rows per value in order of the value, NULL left out."""
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def two_key_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    known = df.filter(F.col(first).isNotNull())
    return known.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).orderBy(first, second)


def distinct_count(df: DataFrame, column: str, name: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.cast("bigint").alias(name))


def band_counts(df: DataFrame, age: str = "age") -> DataFrame:
    """Rows per age band in band order; bands without rows count zero."""
    bands = df.sparkSession.createDataFrame(
        [(i, label) for i, (_, label) in enumerate(typed.AGE_BANDS)], "ordre int, tranche_age string"
    )
    found = df.groupBy(typed.age_band_order(F.col(age)).alias("ordre")).agg(F.count(F.lit(1)).alias("n"))
    # Both sides hold at most one row per band.
    joined = bands.join(F.broadcast(found), "ordre", "left")
    return joined.select("ordre", "tranche_age", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("ordre")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and percent of all rows with a value, one decimal.

    The total is one row, joined back; the counted values are not gathered.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_one", F.lit(1))
    share = round_half_even(100 * F.col("n") / F.col("_total"), 1).alias("pct")
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.select(column, "n", share).orderBy(F.desc("n"), column)


def percent(condition: Column, among: Column | None = None) -> Column:
    """Aggregate: percent of rows, or of the rows of ``among``, that meet it."""
    hit = F.coalesce(condition, F.lit(False)).cast("double")
    return 100 * F.avg(hit if among is None else F.when(among, hit))
