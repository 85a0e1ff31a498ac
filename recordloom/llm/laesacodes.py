"""Codes of vector parts, with codebooks refined on whole numbers; LAESA pivots.

Vectors are cut into consecutive parts; each position has a codebook whose
entries move to the floored mean of the parts assigned to them. The distances of
all parts to a few fixed pivots are computed once and written. In a round only
the entries are compared with the pivots: the largest difference between a
part's and an entry's pivot distances is a lower bound on theirs. Entries are
evaluated in the order of that bound, in whole numbers, until the bounds of the
others exceed the best distance found; the result is exact.

Codebooks and pivots have a fixed size; tasks send back sums per entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import farthest_first, finite, floored, staged
from recordloom.session import BROADCAST_ROW_LIMIT, few_rows_or_none

SCALE = 1024.0
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 12
# Entries evaluated per wave, by bound; the last wave takes all that are left.
WAVES = (4, 16)
CHUNK = 1024
SALTS = 64
UNSEEN = np.iinfo(np.int64).max


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, in whole numbers, last axis components."""
    gap = a - b
    return np.einsum("...d,...d->...", gap, gap)


class Codebook:
    """The entries of one position and their bounds by pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.near = np.sqrt(squared_distances(pivots[:, None], entries[None]).astype(np.float64))

    def assign(self, parts: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (ties to the lower index) and its squared distance."""
        low = np.zeros((len(parts), len(self.entries)))
        for p in range(len(self.near)):
            np.maximum(low, np.abs(near[:, p, None] - self.near[p]), out=low)
        low -= 1e-9 * (1 + near.max(initial=0) + self.near.max(initial=0))  # rounding of the roots
        rows = np.arange(len(parts))[:, None]
        exact = np.full(low.shape, UNSEEN, np.int64)
        best = np.full(len(parts), np.inf)
        for wave in (*WAVES, len(self.entries)):
            alive = np.where(exact == UNSEEN, low, np.inf)
            alive[alive > np.sqrt(best)[:, None] * (1 + 1e-12)] = np.inf
            if wave < len(self.entries):
                pick = np.argpartition(alive, wave - 1, axis=1)[:, :wave]
                hit = np.isfinite(np.take_along_axis(alive, pick, 1))
                r, c = np.broadcast_to(rows, pick.shape)[hit], pick[hit]
            else:
                r, c = np.nonzero(np.isfinite(alive))
            exact[r, c] = squared_distances(parts[r], self.entries[c])
            best = exact.min(1).astype(np.float64)
        code = exact.argmin(1)
        return code, exact[rows[:, 0], code]


def bounds_of(size: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part; lengths that don't divide give parts that differ by one."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


def whole(vectors: pd.Series, size: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64).reshape(len(vectors), size)


class Coder:
    """All codebooks; its methods run in tasks."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray], cuts: list[tuple[int, int]]):
        self.books = [Codebook(b, p) for b, p in zip(books, pivots)]
        self.cuts, self.size = cuts, cuts[-1][1]

    def _assigned(self, batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        v = whole(batch["v"], self.size)
        near = np.stack(batch["near"].to_numpy()).astype(np.float64)
        at = 0
        for p, ((lo, hi), book) in enumerate(zip(self.cuts, self.books)):
            here = near[:, at : at + len(book.pivots)]
            at += len(book.pivots)
            done = [book.assign(v[i : i + CHUNK, lo:hi], here[i : i + CHUNK]) for i in range(0, len(v), CHUNK)]
            yield p, v[:, lo:hi], np.concatenate([c for c, _ in done]), np.concatenate([e for _, e in done])

    def sums(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per part, entry and position the sum of the assigned parts; position -1 holds their number."""
        total = [np.zeros((len(b.entries), 1 + hi - lo), np.int64) for b, (lo, hi) in zip(self.books, self.cuts)]
        for batch in batches:
            if len(batch):
                for p, v, code, _ in self._assigned(batch):
                    np.add.at(total[p], code, np.concatenate([np.ones((len(v), 1), np.int64), v], 1))
        for p, t in enumerate(total):
            entry, place = np.nonzero(np.broadcast_to(t[:, :1] > 0, t.shape))
            yield pd.DataFrame({"part": p, "entry": entry, "place": place - 1, "total": t[entry, place]})

    def codes(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Code and error of each row."""
        for batch in batches:
            if len(batch):
                found = [(code, error) for _, _, code, error in self._assigned(batch)]
                text = ["".join(f"{c:02x}" for c in row) for row in zip(*[c for c, _ in found])]
                yield batch[["id", "label"]].assign(code=text, error=np.sum([e for _, e in found], axis=0))


def refined(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Entries moved to the floored mean of their parts; unused ones stay."""
    count = {(r["part"], r["entry"]): int(r["total"]) for r in sums if r["place"] < 0}
    out = [b.copy() for b in books]
    for r in sums:
        if r["place"] >= 0:
            out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // count[r["part"], r["entry"]]
    return out


def written(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def with_label_sums(rows: DataFrame) -> DataFrame:
    """Adds the error summed over rows of equal label; null labels are one label.

    Sums are broadcast after their number was checked; where there are more, a
    label's rows are spread over ``SALTS`` keys, so a hot one isn't one task.
    """
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    sums = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    few = few_rows_or_none(sums, BROADCAST_ROW_LIMIT)
    if few is not None:
        sums = F.broadcast(rows.sparkSession.createDataFrame(few, sums.schema))
        return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    sums = sums.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at"))).drop("of", "at", "salt")


def encode(
    table: DataFrame, key: Column, vector: Column, label: Column, *, scale: float = SCALE, parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all rows (``id``, ``label``, ``code``, ``error``, ``label_error``) and the final codebooks.

    Components are floor(scale * x), limited to +-2**26. Codebooks start as the
    parts of the ``entries`` smallest ids (equal ids by vector; null ids last);
    with fewer rows they have fewer entries. Rows with null vectors, or null or
    non-finite components, are dropped, and so are those whose length differs
    from that of the smallest id; rows of equal id are coded each. An empty
    table gives no rows and no codebooks. ``entries`` is at most 256.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part")
    spark = table.sparkSession
    base = table.select(key.cast("long").alias("id"), label.alias("label"), vector.alias("v")).where(finite(F.col("v")))
    base = staged(base.withColumn("v", floored(F.col("v"), scale)), "whole-vectors")
    order = (F.asc_nulls_last("id"), F.asc("v"))
    first = base.orderBy(*order).limit(1).collect()
    kinds = f"id long, label {base.schema['label'].dataType.simpleString()}, code string, error long"
    if not first:
        return spark.createDataFrame([], f"{kinds}, label_error long"), []
    size = len(first[0]["v"])
    base = base.where(F.size("v") == size)
    smallest = [r["v"] for r in base.orderBy(*order).limit(entries).collect()]
    seeds = np.array(smallest, np.int64).reshape(len(smallest), size)
    cuts = bounds_of(size, parts)
    books = [seeds[:, lo:hi] for lo, hi in cuts]
    fixed = [b[farthest_first(b.astype(np.float64), pivots)] for b in books]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = whole(batch["v"], size)
                near = [np.sqrt(squared_distances(v[:, None, lo:hi], p[None]).astype(np.float64)) for (lo, hi), p in zip(cuts, fixed)]
                yield batch.assign(near=list(np.concatenate(near, 1)))

    schema = f"id long, label {base.schema['label'].dataType.simpleString()}, v array<long>, near array<double>"
    measured = staged(base.select("id", "label", "v").mapInPandas(measure, schema), "pivot-distances")
    for _ in range(rounds):
        sums = measured.select("v", "near").mapInPandas(Coder(books, fixed, cuts).sums, "part int, entry int, place int, total long")
        whole_sum = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        books = refined(books, sums.groupBy("part", "entry", "place").agg(whole_sum).collect())
    coded = staged(measured.mapInPandas(Coder(books, fixed, cuts).codes, kinds), "codes")
    return with_label_sums(coded), books


def query(embeddings: DataFrame) -> DataFrame:
    """Code and errors of every vector, with the checksum of the codebooks."""
    coded, books = encode(embeddings, F.col("vec_id"), F.col("embedding"), F.col("label"))
    checksum = hashlib.sha256(written(books).encode()).hexdigest()
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(checksum).alias("codebooks_sha256"))
