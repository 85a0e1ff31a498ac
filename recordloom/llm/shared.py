"""Small helpers of the operators in this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import session

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; cuts the lineage."""
    return session.staged(df, label)


def fresh(name: str) -> str:
    """A column name that no input table has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, beside ``columns``.

    Helper columns then never clash with columns of the input.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *columns)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """How many words a text has; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def removed(text: Column, pattern: str) -> Column:
    """How many code points of ``text`` the matches of ``pattern`` hold."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


# Running values are built in blocks of this many, as appending copies an array.
RUN_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """What merging an array from the front gives at each place.

    Blocks first, then what stands before each block: the work is in
    proportion to the array, but for a small share of its square.
    """
    none = F.array().cast(f"array<{kind}>")

    def append(so_far: Column, x: Column) -> Column:
        return let(F.try_element_at(so_far, F.lit(-1)), lambda last: F.array_append(so_far, F.when(last.isNull(), x).otherwise(merge(last, x))))

    def joined(blocks: Column) -> Column:
        ends = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), none, append)
        later = F.zip_with(F.slice(blocks, 2, F.size(blocks)), ends, lambda b, e: F.when(b.isNotNull(), F.transform(b, lambda x: merge(e, x))))
        return F.concat(F.element_at(blocks, 1), F.flatten(F.filter(later, lambda b: b.isNotNull())))

    def in_blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / F.lit(float(RUN_BLOCK))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(v, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK)), none, append))
        return F.when(F.size(v) == 0, none).otherwise(let(cut, joined))

    return let(values, in_blocks)


# Whole-number components stay inside this, so that sums of squares hold in 64 bits.
WHOLE_LIMIT = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def floored(vector: Column, scale: float) -> Column:
    """Every component x as the whole number floor(scale * x), taken as a double first.

    What lies outside of +-``WHOLE_LIMIT`` is set to that limit.
    """
    edge = F.lit(float(WHOLE_LIMIT))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(-edge, F.least(edge, x * F.lit(float(scale))))))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` different points, each as far as can be from those before it."""
    chosen = [0] if len(points) else []
    far = ((points - points[0]) ** 2).sum(1) if len(points) else np.empty(0)
    while chosen and len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen, np.int64)
