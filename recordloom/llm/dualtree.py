"""Ranked lexical search: every item's best documents, by a dual-tree search.

One pass over the texts counts, per document, its terms and those that any item
holds; the sparse counts are written. Document frequencies and lengths come
from all documents. A second pass takes the counts in batches and builds two
hierarchies: documents of like heavy terms under leaves and parents, items under
nodes of nodes. A node holds the highest value of each coordinate below it (the
gain of a term in a document, the presence of a term in an item), so the product
of two nodes bounds every score between them. A pair of nodes is left out when
its bound is under the weakest k-th score among the node's items; what remains
is scored exactly. Every task keeps the k best of each item; a window joins the
lists of the tasks.

Items are held in memory in sets of bounded text length, and in blocks of
bounded size within; documents stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.shared import staged

K = 50
LEAF, PARENT = 16, 16
ITEM_NODE = 8
# Items of one set hold at most about this many characters (one item may hold more).
SET_CHARS = 4_000_000
# Cells of the tables of a block of items and of the nodes of a batch.
ITEM_CELLS, NODE_CELLS = 1 << 23, 1 << 21
BATCH_LEAVES = 256
#: ASCII letters and digits and everything beyond ASCII belong to terms; A-Z are lower-cased.
TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HIGHEST_GAIN = 10**6


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode().translate(TO_TERMS).split()


def by_node(node: np.ndarray, term: np.ndarray, value: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Dense table of the highest value per node and term."""
    out = np.zeros((nodes, width))
    if len(node):
        cell = node * width + term
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out.ravel()[cell[heads]] = np.maximum.reduceat(value, heads)
    return out


def grouped_max(rows: np.ndarray, size: int) -> np.ndarray:
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


class Items:
    """A block of items: their terms, weights and hierarchy. ``items`` holds sorted term numbers."""

    def __init__(self, numbers: list[int], items: list[np.ndarray], weight: dict[int, int]):
        rarest = [max(((weight.get(int(t), 0), int(t)) for t in i), default=(0, -1))[::-1] for i in items]
        order = sorted(range(len(items)), key=lambda i: (rarest[i], i))
        self.numbers = np.array([numbers[i] for i in order], np.int64)
        self.terms = np.unique(np.concatenate([items[i] for i in order]))
        self.weights = np.array([weight.get(int(t), 0) for t in self.terms], np.int64)
        self.holds = np.zeros((len(order), len(self.terms)))
        for row, i in enumerate(order):
            self.holds[row, np.searchsorted(self.terms, items[i])] = 1.0
        self.nodes = grouped_max(self.holds, ITEM_NODE)
        self.tops = grouped_max(self.nodes, ITEM_NODE)
        most = int(self.weights.max(initial=0)) * HIGHEST_GAIN * int(self.holds.sum(1).max(initial=0))
        # sums of whole numbers are exact in doubles below 2**53
        self.kind = np.float64 if most < 2**53 else np.int64


class Best:
    """The k best documents of each item so far."""

    def __init__(self, count: int, k: int):
        self.k, self.weakest = k, np.ones(count)
        self.item, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, score])
        key = np.concatenate([self.key, key])
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        heads = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        rank = np.arange(len(item)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(item)]])))
        keep = rank < self.k
        self.item, self.score, self.key = item[keep], score[keep], key[keep]
        last = rank == self.k - 1
        self.weakest[item[last]] = np.maximum(score[last], 1)


def search_batch(items: Items, best: Best, keys: np.ndarray, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> int:
    """Scores a batch of documents against all items; ``doc``, ``term`` and ``gain`` are parallel.

    ``term`` numbers the block's terms, ``doc`` places in ``keys``. Returns how
    many scores the bounds left to compute.
    """
    scored = 0
    width = len(items.terms)
    # like documents stand together: by heaviest term, then by its gain
    order = np.lexsort((gain, doc))
    last = np.flatnonzero(np.concatenate([doc[order][1:] != doc[order][:-1], [True]]))
    heaviest, high = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    heaviest[doc[order][last]], high[doc[order][last]] = term[order][last], gain[order][last]
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -high, heaviest))] = np.arange(len(keys))
    place = rank[doc]
    by_place = np.argsort(place, kind="stable")
    place, term, gain = place[by_place], term[by_place], gain[by_place]
    sorted_keys = np.empty_like(keys)
    sorted_keys[rank] = keys
    leaves = -(-len(keys) // LEAF)
    leaf_max = by_node(place // LEAF, term, gain, leaves, width)
    parent_max = grouped_max(leaf_max, PARENT)
    starts = np.searchsorted(place, np.arange(0, leaves + 1) * LEAF)
    reach = parent_max @ items.tops.T
    for parent in np.argsort(-reach.max(1), kind="stable"):
        found = []
        weakest_node = np.minimum.reduceat(best.weakest, np.arange(0, len(best.weakest), ITEM_NODE))
        weakest_top = np.minimum.reduceat(weakest_node, np.arange(0, len(weakest_node), ITEM_NODE))
        tops = np.flatnonzero(reach[parent] >= weakest_top)
        if not len(tops):
            continue
        nodes = (tops[:, None] * ITEM_NODE + np.arange(ITEM_NODE)).ravel()
        nodes = nodes[nodes < len(items.nodes)]
        nodes = nodes[items.nodes[nodes] @ parent_max[parent] >= weakest_node[nodes]]
        own = np.arange(parent * PARENT, min((parent + 1) * PARENT, leaves))
        pairs = leaf_max[own] @ items.nodes[nodes].T >= weakest_node[nodes]
        for leaf, mine in zip(own, pairs):
            some = (nodes[mine][:, None] * ITEM_NODE + np.arange(ITEM_NODE)).ravel()
            some = some[some < len(items.holds)]
            some = some[items.holds[some] @ leaf_max[leaf] >= best.weakest[some]]
            lo, hi = starts[leaf], starts[leaf + 1]
            if not len(some) or lo == hi:
                continue
            used, column = np.unique(term[lo:hi], return_inverse=True)
            rows = np.zeros((LEAF, len(used)), items.kind)
            rows[place[lo:hi] - leaf * LEAF, column] = gain[lo:hi]
            scores = rows @ items.holds[np.ix_(some, used)].astype(items.kind).T
            scored += scores.size
            r, c = np.nonzero(scores >= best.weakest[some])
            found.append((some[c], scores[r, c].astype(np.int64), sorted_keys[leaf * LEAF + r]))
        if found:
            best.add(*map(np.concatenate, zip(*found)))
    return scored


def gains(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term adds to a score, in whole numbers, from its weight, occurrences and document length."""
    m = 100 - 50 + (50 * n * documents) // words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def counted(docs: DataFrame, key: Column, text: Column, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents with terms: ``key``, number of terms ``n``, and numbers and counts of the known ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"key": [], "n": [], "terms": [], "tf": []}
            for k, t in zip(batch["key"], batch["text"]):
                words = terms_of(t)
                if words:
                    known = np.fromiter((x for x in map(vocabulary.get, words) if x is not None), np.int32)
                    found, times = np.unique(known, return_counts=True)
                    for name, value in zip(out, (k, len(words), found, times)):
                        out[name].append(value)
            yield pd.DataFrame({name: pd.Series(value, dtype=object) for name, value in out.items()})

    rows = docs.where(text.isNotNull() & key.isNotNull()).select(key.cast("long").alias("key"), text.alias("text"))
    return rows.mapInPandas(count, "key long, n long, terms array<int>, tf array<long>")


def searched(rows: DataFrame, items: Items, documents: int, words: int, k: int) -> DataFrame:
    """The k best documents of each item of a block, per task: ``number``, ``doc_id``, ``score``."""
    size = LEAF * max(1, min(BATCH_LEAVES, NODE_CELLS // max(1, len(items.terms))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(items.numbers), k)
        for batch in batches:
            for at in range(0, len(batch), size):
                some = batch.iloc[at : at + size]
                sizes = some["terms"].map(len).to_numpy()
                term = np.concatenate(some["terms"].to_numpy()).astype(np.int64)
                tf = np.concatenate(some["tf"].to_numpy()).astype(np.int64)
                doc = np.repeat(np.arange(len(some)), sizes)
                column = np.minimum(np.searchsorted(items.terms, term), len(items.terms) - 1)
                known = items.terms[column] == term
                doc, column, tf = doc[known], column[known], tf[known]
                if len(doc):
                    gain = gains(items.weights[column], tf, some["n"].to_numpy(np.int64)[doc], documents, words)
                    search_batch(items, best, some["key"].to_numpy(np.int64), doc, column, gain)
        yield pd.DataFrame({"number": items.numbers[best.item], "doc_id": best.key, "score": best.score})

    return rows.mapInPandas(search, "number long, doc_id long, score long")


def blocks_of(items: list[np.ndarray]) -> Iterator[list[int]]:
    """Consecutive items whose table of items by terms stays bounded."""
    block, terms = [], set()
    for i, found in enumerate(items):
        more = terms | set(found.tolist())
        if block and (len(block) + 1) * len(more) > ITEM_CELLS:
            yield block
            block, more = [], set(found.tolist())
        block.append(i)
        terms = more
    if block:
        yield block


def ranked(
    docs: DataFrame, key: Column, text: Column, items: DataFrame, item_key: Column, item_text: Column, *, k: int = K
) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item.

    Returns ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``; equal
    scores by ascending doc_id. Every row of ``items`` is an item of its own,
    also with an equal or null id. Documents are rows: a repeated row is ranked
    twice. Documents with a null id or text are no documents here and count
    nowhere; texts without terms neither. Items without terms get no rows.
    """
    spark = docs.sparkSession
    asked = items.select(item_key.alias("item_id"), item_text.alias("text"), F.xxhash64(item_key, item_text).alias("part"))
    asked = asked.where("text is not null")
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    sets = max(1, -(-chars // SET_CHARS))
    kind = asked.schema["item_id"].dataType.simpleString()
    results = []
    for part in range(sets):
        rows = asked.where(F.pmod("part", F.lit(sets)) == part).orderBy("item_id", "text").collect()
        found = [sorted(set(terms_of(r["text"]))) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        known = staged(counted(docs, key, text, vocabulary), "term-counts")
        total = known.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
        if not vocabulary or not total["documents"]:
            continue
        frequency = known.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weight = {r["term"]: math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * r["count"] + 1))) for r in frequency}
        numbers = [np.array([vocabulary[t] for t in f], np.int64) for f in found]
        filled = [i for i, f in enumerate(numbers) if len(f)]
        for block in blocks_of([numbers[i] for i in filled]):
            mine = [filled[i] for i in block]
            tree = Items(mine, [numbers[i] for i in mine], weight)
            names = spark.createDataFrame([(i, rows[i]["item_id"]) for i in mine], f"number long, item_id {kind}")
            best = searched(known, tree, total["documents"], total["words"], k)
            rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "doc_id"))
            top = best.withColumn("rank", rank).where(F.col("rank") <= k)
            results.append(top.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for r in results:
        out = out.unionByName(r)
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked(docs, F.col("doc_id"), F.col("text"), benchmark, F.col("item_id"), F.col("text"))
