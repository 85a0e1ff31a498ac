"""Approximate nearest neighbours by cosine: robust-pruned directed graphs in shards.

Equal vectors are one point. Points are dealt into shards of bounded size by a
hash; each shard holds a graph in which every point keeps few, diverse edges:
greedy searches propose neighbours, and a neighbour is dropped if one already
kept is nearer to it by the factor ``alpha``. A query walks every shard with a
beam and keeps the best points found; scores are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.shared import staged

SHARD_POINTS = 2048
DEGREE = 24
BEAM = 64
ALPHA = 1.2
BATCH = 256


def beam_search(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best points met from each query, nearest first, and their similarities.

    All queries step together: each expands its best point not yet expanded.
    Missing edges are -1.
    """
    m = len(queries)
    rows = np.arange(m)
    best = np.full((m, beam), -1, np.int64)
    near = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, len(points)), bool)
    start = entry[:beam]
    best[:, : len(start)], near[:, : len(start)], done[:, : len(start)] = start, queries @ points[start].T, False
    seen[:, start] = True
    while True:
        open_ = np.where(done, -np.inf, near)
        pick = open_.argmax(1)
        active = np.flatnonzero(open_[rows, pick] > -np.inf)
        if not len(active):
            break
        done[active, pick[active]] = True
        new = edges[best[active, pick[active]]]
        fresh = (new >= 0) & ~seen[active[:, None], new]
        seen[active[:, None], np.where(fresh, new, new[:, :1])] |= fresh
        sims = np.where(fresh, np.einsum("qrd,qd->qr", points[new], queries[active]), -np.inf)
        all_best = np.concatenate([best[active], new], 1)
        all_near = np.concatenate([near[active], sims], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        order = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        take = lambda x: np.take_along_axis(x, order, 1)
        best[active], near[active], done[active] = take(all_best), take(all_near), take(all_done)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)


def prune(points: np.ndarray, node: int, offered: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of a point: nearest first, each dropping those it is nearer to by ``alpha``."""
    offered = np.unique(offered[(offered >= 0) & (offered != node)])
    far = 2 - 2 * (points[offered] @ points[node])
    order = np.argsort(far, kind="stable")
    offered, far = offered[order], far[order]
    between = 2 - 2 * (points[offered] @ points[offered].T)
    alive, kept = np.ones(len(offered), bool), []
    for i in range(len(offered)):
        if alive[i]:
            kept.append(offered[i])
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > far
    return np.array(kept, np.int64)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1 where missing) and entry points of the graph of a shard."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    entry = np.argsort(-(points @ points.mean(0)), kind="stable")[:1]
    order = np.random.default_rng(3).permutation(n)
    for final in (1.0, alpha):
        inserted, size = 0, 16
        while inserted < n:
            batch = order[inserted : inserted + min(size, BATCH)]
            found, _ = beam_search(points, edges, entry, points[batch], beam)
            back: dict[int, list[int]] = {}
            for node, candidates in zip(batch, found):
                # batch mates are offered too: they are not yet in the graph
                mates = batch[np.argpartition(-(points[batch] @ points[node]), min(8, len(batch) - 1))[:8]] if len(batch) > 1 else batch
                kept = prune(points, node, np.concatenate([candidates, edges[node], mates, entry]), degree, final)
                edges[node] = -1
                edges[node, : len(kept)] = kept
                for k in kept:
                    back.setdefault(int(k), []).append(int(node))
            for k, more in back.items():
                old = edges[k][edges[k] >= 0]
                both = np.unique(np.concatenate([old, more]))
                if len(both) > degree:
                    both = prune(points, k, both, degree, final)
                edges[k] = -1
                edges[k, : len(both)] = both
            inserted += len(batch)
            size *= 2
    return edges, entry


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one, scaled first so that squares neither vanish nor overflow."""
    m = np.stack(vectors.to_numpy())
    m = m / np.abs(m).max(1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no non-finite component, not zero, not empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    table: DataFrame, key: Column, vector: Column, is_query: Column, *, k: int = 5,
    shard_points: int = SHARD_POINTS, beam: int = BEAM,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row, its own row left out.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine in
    double precision, on the original vectors); ties go to the smaller id. Rows
    with unusable vectors take no part; vectors of different lengths are never
    compared. Keys shall be distinct and not null; null keys take no part.
    With fewer candidates than ``k`` all are returned.
    """
    base = table.select(key.alias("id"), vector.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = staged(base.where(usable(F.col("v")) & F.col("id").isNotNull()), "vectors")
    # a class of equal vectors shows at most its k + 1 smallest ids: one may be the query itself
    same = F.xxhash64("v")
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = F.row_number().over(Window.partitionBy("same", "v", "salt").orderBy("id"))
    few = base.select("id", "v", same.alias("same"), salt.alias("salt")).withColumn("r", first).where(F.col("r") <= k + 1)
    second = F.row_number().over(Window.partitionBy("same", "v").orderBy("id"))
    few = few.withColumn("r", second).where(F.col("r") <= k + 1)
    points = staged(few.groupBy("same", "v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard_points))
    queries = base.where("q").select("v").distinct()
    dealt = points.select("point", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("point"), F.lit(shards)).alias("shard"))
    asked = points.join(queries, "v", "left_semi").select(
        "point", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, some in group.groupby(group["v"].map(len)):
            own, asks = some[~some["asks"]], some[some["asks"]]
            if own.empty or asks.empty:
                continue
            own = own.sort_values("point")
            p, ids = unit(own["v"]), own["point"].to_numpy()
            edges, entry = build(p)
            qs, qid = unit(asks["v"]), asks["point"].to_numpy()
            for at in range(0, len(qs), 512):
                found, _ = beam_search(p, edges, entry, qs[at : at + 512], min(beam, len(p)))
                found = found[:, : k + 3]
                who = np.repeat(qid[at : at + 512], found.shape[1])
                hit = found.ravel() >= 0
                out.append(pd.DataFrame({"asker": who[hit], "point": ids[found.ravel()[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"asker": pd.Series([], dtype="int64"), "point": pd.Series([], dtype="int64")})

    found = dealt.unionByName(asked).groupBy("shard").applyInPandas(search, "asker long, point long")
    # a query's own class is a candidate too: its other members have the same vector
    own = points.join(queries, "v", "left_semi").select(F.col("point").alias("asker"), "point")
    found = found.unionByName(own).distinct()
    left = points.select(F.col("point").alias("asker"), F.col("v").alias("a"))
    right = points.select("point", F.col("v").alias("b"), "ids")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> float:
            return float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    scored = staged(found.join(left, "asker").join(right, "point").select("asker", "ids", cosine("a", "b").alias("score")), "scored")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), F.element_at("ids", 1))
    scored = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1 + 2)
    asker = points.select(F.col("point").alias("asker"), "v")
    persons = base.where("q").select(F.col("id").alias("query_id"), "v").join(asker, "v").select("query_id", "asker")
    rows = persons.join(scored, "asker").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest rows for every id divisible by 50."""
    return nearest(embeddings, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 50 == 0)
