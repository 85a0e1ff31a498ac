"""Mixing sources to target weights by systematic sampling.

Every row of a source is expected to be taken ``target / source_size`` times.
The rows of a source stand in one order, their expected copies are summed up
from the front, one random offset is added, and a row is emitted once for each
integer that its own step crosses. Rows are ordered by size, so that the words
taken differ from the target by at most the span of sizes in the source.

No step holds a source in one task: rows are counted by (source, size, one of
256 buckets) before the first shuffle, prefix sums run over those counts, and
only the rows of one such cell are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.shared import staged, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 256
CELL = ["no_source", "source_key", "size", "bucket"]


def ranked_sources(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` with the weight each gets by its place in code point order.

    A global rank without a single-task window: rows are sorted into ranges,
    numbered inside each range, and ranges are offset by the counts before.
    """
    numbered = staged(
        sources.orderBy("no_source", "source_key").withColumn("number", F.monotonically_increasing_id()), "sources"
    )
    parts = numbered.groupBy(F.shiftright("number", 33).alias("part")).count().orderBy("part").collect()
    before, start = 0, F.lit(0)
    for part in parts:
        start = F.when(F.shiftright("number", 33) >= part["part"], F.lit(before)).otherwise(start)
        before += part["count"]
    place = (start + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    return numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """Words per unit of weight: capped sources keep their cap, the rest share what is left."""
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * level
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)).alias("spent"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            return level
        new = (share * float(row["all"]) - row["spent"]) / row["open"]
        if new <= level:
            return level
        level = new


def systematic_mix(
    docs: DataFrame,
    text: Column,
    source: Column,
    key: Column,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 42,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """How often the mix takes each row of ``docs``.

    Returns ``row`` (struct of all input columns), ``size`` (words),
    ``source_size``, ``target`` (words the source should give) and ``copies``
    (0, 1 or 2 with the default cap). ``key`` only breaks ties between rows of
    equal size; rows equal in key and text are interchangeable. ``carry`` names
    the input columns that ``row`` shall hold, all by default.

    Null texts have size 0. A null source is a source of its own, last in
    order. A source of size 0 has target 0 and is never taken. An empty table
    gives an empty result. The offset depends on seed and source only, so
    reruns agree.
    """
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)]).alias("row"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source_key"),
        word_count(text).alias("size"),
        F.xxhash64(key, text).alias("tie"),
    ).withColumn("bucket", F.pmod("tie", F.lit(BUCKETS)).cast("int"))
    counts = staged(rows.groupBy(*CELL).agg(F.count("*").alias("n")), "mix-counts")
    sources = ranked_sources(
        counts.groupBy(*CELL[:2]).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights
    )
    level = water_level(sources, share, cap)
    limit = F.col("source_size") * F.lit(cap)
    aims = sources.select(
        *CELL[:2],
        "source_size",
        F.least(limit, F.col("weight") * F.lit(level)).cast("double").alias("target"),
        (F.pmod(F.xxhash64("source_key", "no_source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("offset"),
    )
    by_size = Window.partitionBy(*CELL[:2]).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy(*CELL[:3]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    smaller = counts.groupBy(*CELL[:3]).agg(F.sum("n").alias("n")).select(
        *CELL[:3], F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("smaller")
    )
    cells = (
        counts.withColumn("within", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)))
        .join(smaller, CELL[:3])
        .join(aims, CELL[:2])
        .select(*CELL, "source_size", "target", "offset", (F.col("smaller") + F.col("within")).alias("ahead"))
    )
    inside = F.row_number().over(Window.partitionBy(*CELL).orderBy("tie"))
    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    step = lambda rank: F.floor(rank * F.col("per_row") + F.col("offset"))
    return (
        rows.join(cells, CELL)
        .withColumn("rank", F.col("ahead") + inside)
        .withColumn("per_row", per_row)
        .select("row", "size", "source_size", "target", (step(F.col("rank")) - step(F.col("rank") - 1)).alias("copies"))
    )


def emit(mix: DataFrame) -> DataFrame:
    """The mixed rows themselves: each as often as it was taken, with the input's columns."""
    taken = mix.where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of every document."""
    return systematic_mix(
        docs.select("doc_id", "source", "text"), F.col("text"), F.col("source"), F.col("doc_id"), carry=("doc_id",)
    ).select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
