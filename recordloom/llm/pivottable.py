"""Exact top-k search by inner product: pivot-table elimination.

Components are whole numbers. With one more coordinate every row gets the same
length, so the highest inner product is the smallest distance, and the triangle
inequality holds. The distances of every row to many pivots are computed once
and written beside it. For a query, the largest difference between its pivot
distances and a row's bounds their distance from below, and so their score from
above; rows are scored in the order of that bound until the bound of the next
row can no longer reach the k-th best score. What is never scored can't be in
the result.

Rows stand in blocks: rows nearest to the same pivot together, crowded cells
cut by a hash, sparse cells joined, so a block is bounded whatever the data.
A query searches its own block first, then all others with the k-th score it
has found; a block streams past the queries sent to it and holds no list of
them. Blocks are shuffled from a written table: a lost task is redone from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.shared import farthest_first, finite, floored, staged
from recordloom.session import few_rows_or_none

SCALE = 1024.0
PIVOTS = 64
# Pivots are chosen among this many rows; any pivots give exact results.
SAMPLE = 2048
# Rows of a block: a 256th of the table within these bounds.
BLOCK_ROWS = (8192, 65536)
FIRST_PIVOTS = 8
FIRST_SCORED = 64


class Pivots:
    """Pivots per vector length, in the space in which all rows have the same length."""

    def __init__(self, sample: list[np.ndarray], longest: float, count: int):
        self.longest = longest  # the largest squared length of any row
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        first = 0
        for size in sorted({len(v) for v in sample}):
            some = [v for v in sample if len(v) == size]
            v = np.array(some, np.float64).reshape(len(some), size)
            lifted = np.concatenate([v, self.lift(v)[:, None]], 1)
            kept = lifted[farthest_first(lifted, count)]
            self.by_size[size] = kept[:, :-1], kept[:, -1], first
            first += len(kept)

    def lift(self, v: np.ndarray) -> np.ndarray:
        """The further coordinate of rows."""
        return np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))

    def distances(self, v: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """Distance of each row to each pivot of its length."""
        pivot, tops, _ = self.by_size[v.shape[1]]
        flat = (v * v).sum(1)[:, None] + (pivot * pivot).sum(1) - 2 * (v @ pivot.T)
        return np.sqrt(np.maximum(flat + (lift[:, None] - tops) ** 2, 0))

    def measure(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds to rows the distances as a row and, as a query, and the cell.

        As a query the further coordinate is 0. Lengths without pivots have no
        distances and share the cell -1.
        """
        for batch in batches:
            near: list = [[]] * len(batch)
            asks: list = [[]] * len(batch)
            cell = np.full(len(batch), -1, np.int64)
            sizes = batch["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                if size in self.by_size:
                    at = np.flatnonzero(sizes == size)
                    v = np.stack(batch["v"].iloc[at].to_numpy()).astype(np.float64).reshape(len(at), size)
                    own = self.distances(v, self.lift(v))
                    cell[at] = self.by_size[size][2] + own.argmin(1)
                    asked = self.distances(v, np.zeros(len(at)))
                    for place, row, query in zip(at, own, asked):
                        near[place] = row
                        if batch["q"].iloc[place]:
                            asks[place] = query
            if len(batch):
                yield batch.assign(near=near, asks=asks, cell=cell)


class Block:
    """The rows of one block, searched by one query after another."""

    def __init__(self, rows: pd.DataFrame, longest: float, k: int):
        self.longest, self.k = longest, k
        # products and all their partial sums are at most ``longest``: exact in doubles below 2**53
        self.kind = np.float64 if longest < 2**53 else np.int64
        rows = rows.sort_values("id")
        sizes = rows["v"].map(len).to_numpy()
        self.parts = {}
        for size in np.unique(sizes):
            some = rows[sizes == size]
            v = np.stack(some["v"].to_numpy()).astype(self.kind).reshape(len(some), size)
            near = np.stack(some["near"].to_numpy()).astype(np.float64)
            self.parts[int(size)] = some["id"].to_numpy(), v, np.ascontiguousarray(near.T)

    def bounds(self, near: np.ndarray, asks: np.ndarray, squared: float, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that can still reach ``least``, best bound first, and their bounds on the score."""
        slack = 1e-7 * np.sqrt(self.longest) + 1e-9

        def highest(low: np.ndarray) -> np.ndarray:
            low = np.maximum(low - slack, 0)
            return (squared + self.longest - low * low) / 2 + 1 + 1e-12 * self.longest

        place = np.arange(near.shape[1])
        low = np.zeros(len(place))
        for lo, hi in ((0, FIRST_PIVOTS), (FIRST_PIVOTS, len(near))):
            if hi > lo and len(near) > lo:
                low = np.maximum(low, np.abs(near[lo:hi, place] - asks[lo:hi, None]).max(0))
            if least is not None:
                alive = highest(low) >= least
                place, low = place[alive], low[alive]
        order = np.argsort(low, kind="stable")
        return place[order], highest(low[order])

    def best(self, ident: int, v: np.ndarray, asks: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows with at least the score ``least``; ties to smaller ids."""
        ids, scores = np.empty(0, np.int64), np.empty(0, self.kind)
        if len(v) not in self.parts:
            return ids, scores
        own, rows, near = self.parts[len(v)]
        v = v.astype(self.kind)
        place, high = self.bounds(near, asks, float((v * v).sum()), least)
        at, step = 0, FIRST_SCORED
        while at < len(place) and (least is None or high[at] >= least):
            some = place[at : at + step]
            some = some[own[some] != ident]
            found = rows[some] @ v
            ids, scores = np.concatenate([ids, own[some]]), np.concatenate([scores, found])
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
            if len(ids) == self.k:
                least = scores[-1] if least is None else max(least, scores[-1])
            at, step = at + step, 2 * step
        fit = scores >= least if least is not None else slice(None)
        return ids[fit], scores[fit]


def one_row_each(rows: DataFrame) -> DataFrame:
    """Rows of one id become the one with the smallest vector."""
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if few_rows_or_none(twice, 0) == []:
        return rows
    single = rows.join(twice, "id", "left_anti")
    several = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("v", "q")).alias("s"))
    return single.select("id", "v", "q").unionByName(several.select("id", "s.v", "s.q"))


def in_blocks(measured: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """Adds the block of every row; returns the number of blocks too.

    There are at most as many cells as sampled rows, so their counts may be
    read by the driver.
    """
    spark = measured.sparkSession
    places, blocks, room = [], 0, 0
    for cell, count in sorted(map(tuple, measured.groupBy("cell").count().collect())):
        parts = -(-count // block_rows)
        if parts == 1 and count <= room:
            room -= count
            places.append((cell, blocks - 1, 1))
        else:
            places.append((cell, blocks, parts))
            blocks += parts
            room = block_rows - count if parts == 1 else 0
    table = spark.createDataFrame(places, "cell long, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    return measured.join(F.broadcast(table), "cell").withColumn("block", block).drop("cell", "first", "parts"), blocks


def visited(rows: DataFrame, asked: DataFrame, longest: float, k: int) -> DataFrame:
    """What queries find in the blocks they are sent to: ``query_id``, ``vec_id``, ``score``."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, own, index = None, [], None
        for batch in batches:
            for number, run in batch.groupby("block", sort=False):
                if number != block:
                    block, own, index = number, [], None
                asks = run["asking"].to_numpy()
                if not asks.all():
                    own.append(run[~asks])
                if not asks.any() or not own and index is None:
                    continue
                if index is None:
                    index, own = Block(pd.concat(own), longest, k), []
                out = []
                for ident, v, near, least in zip(*[run.loc[asks, c] for c in ("id", "v", "near", "least")]):
                    ids, scores = index.best(ident, np.asarray(v), np.asarray(near, np.float64), None if np.isnan(least) else int(least))
                    out.append(pd.DataFrame({"query_id": ident, "vec_id": ids, "score": scores.astype(np.int64)}))
                yield pd.concat(out)

    candidates = rows.select("block", F.lit(False).alias("asking"), "id", "v", "near", F.lit(None).cast("double").alias("least"))
    queries = asked.select("block", F.lit(True).alias("asking"), "id", "v", F.col("asks").alias("near"), F.col("least").cast("double"))
    both = candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "asking")
    return both.mapInPandas(visit, "query_id long, vec_id long, score long")


def highest(
    table: DataFrame, key: Column, vector: Column, is_query: Column, *, k: int = 10, scale: float = SCALE,
    pivots: int = PIVOTS, block_rows: int | None = None,
) -> DataFrame:
    """The ``k`` rows with the highest inner product for each query row, its own row left out.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go
    to the smaller id; with fewer candidates than ``k`` all are returned.
    Components are floor(scale * x), limited to +-2**26. Rows with null or
    non-finite components, null vectors or null ids take no part. Empty
    vectors score 0 with each other; vectors of different lengths are never
    compared. Rows that share an id count once, with the smallest vector. A
    null ``is_query`` is false. An empty table gives no rows.
    """
    base = table.select(key.cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(finite(F.col("v")) & F.col("id").isNotNull()).withColumn("v", floored(F.col("v"), scale))
    base = staged(one_row_each(staged(base, "whole-vectors")), "distinct-vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    longest, total = base.agg(F.coalesce(F.max(squared), F.lit(0.0)), F.count(F.lit(1))).first()
    sample = [np.array(r["v"], np.float64) for r in base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    table_of = Pivots(sample, longest, pivots)
    measured = base.mapInPandas(
        table_of.measure, "id long, v array<long>, q boolean, near array<double>, asks array<double>, cell long"
    )
    least, most = BLOCK_ROWS
    rows, blocks = in_blocks(staged(measured, "pivot-distances"), block_rows or min(most, max(least, total // 256)))
    rows = staged(rows, "pivot-blocks")
    asked = rows.where("q").drop("near")
    near = staged(visited(rows, asked.withColumn("least", F.lit(None).cast("long")), longest, k), "own-block")
    found = near
    if blocks > 1:
        reached = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        asked = asked.join(reached, asked["id"] == reached["query_id"], "left").drop("query_id")
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        sent = asked.withColumnRenamed("block", "own").withColumn("block", others).where("block != own")
        found = near.unionByName(visited(rows, sent, longest, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The 10 highest inner products for every id divisible by 100."""
    return highest(embeddings, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 100 == 0)
