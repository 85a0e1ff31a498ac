"""Token ids on disk, with a minimal perfect hash from document key to place.

File format: parquet rows, one per shard. Keys ascend through the shards.

| column | content |
| --- | --- |
| ``part``, ``shard`` | range of keys and number inside it, both ascending |
| ``n_docs``, ``n_tokens`` | rows and ids in the shard |
| ``keys``, ``has_key`` | int64 keys in order; 0 in ``has_key`` marks a null key |
| ``payload`` | all ids, little-endian unsigned 32 bit, document after document |
| ``sizes`` | level sizes of the hash, int64 |
| ``bits`` | level bit arrays, 64-bit words |
| ``slots`` | per hash value: fingerprint uint32, rows uint32, first id uint64 |
| ``lengths`` | ids of every row, uint32 |

A key is hashed level by level; the first level whose bit is set holds it, and
its hash value is the number of bits set before. So a lookup costs a few
probes, whatever the size of the shard, and the fingerprint turns away (all but
1 in 2**32 of) the keys that were never stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom import session
from recordloom.llm.tokens import END_ID, encoder, vocabulary_path

SHARD_BYTES = 4 << 20
SCHEMA = (
    "part long, shard long, n_docs long, n_tokens long, keys binary, has_key binary, payload binary,"
    " sizes binary, bits binary, slots binary, lengths binary"
)
SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<u8")])


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of int64 keys (splitmix finalizer)."""
    x = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash over distinct int64 keys: levels of collision-free bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, left, level = [], [], keys, 1
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            place = mixed(left, level) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            left, level = left[~alone[place.astype(np.int64)]], level + 1
        return cls(np.array(sizes, "<i8"), np.concatenate(arrays) if arrays else np.empty(0, "<u8"))

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Hash value of each key; -1 if it is surely none of the stored ones."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist(), 1):
            at = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level - 1]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def shard_row(part: int, shard: int, keys: list[int | None], encoded: list[bytes]) -> dict:
    """One shard in the file format; keys ascend, equal keys and null keys stand together."""
    known = np.array([k is not None for k in keys], bool)
    values = np.array([k if k is not None else 0 for k in keys], "<i8")
    lengths = np.array([len(e) // 4 for e in encoded], "<u4")
    first = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)])[:-1].astype(np.uint64)
    distinct, at, rows = np.unique(values[known], return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    place = hashed.values(distinct)
    slots["print"][place], slots["rows"][place] = fingerprints(distinct), rows
    slots["first"][place] = first[known][at] if len(at) else first[:0]
    return {
        "part": part, "shard": shard, "n_docs": len(keys), "n_tokens": int(lengths.sum(dtype=np.int64)),
        "keys": values.tobytes(), "has_key": known.astype(np.uint8).tobytes(), "payload": b"".join(encoded),
        "sizes": hashed.sizes.tobytes(), "bits": hashed.bits.tobytes(), "slots": slots.tobytes(),
        "lengths": lengths.tobytes(),
    }


def lookup(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of rows of each key in a shard; 0 rows where it isn't stored."""
    hashed = PerfectHash(np.frombuffer(shard["sizes"], "<i8"), np.frombuffer(shard["bits"], "<u8"))
    slots = np.frombuffer(shard["slots"], SLOT)
    value = hashed.values(keys)
    found = value >= 0
    found[found] = slots["print"][value[found]] == fingerprints(keys[found])
    at = np.where(found, value, 0)
    if not len(slots):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    return slots["first"][at].astype(np.int64), np.where(found, slots["rows"][at], 0).astype(np.int64)


def write_store(docs: DataFrame, key: Column, text: Column, folder: str, *, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts, in ascending order of key, and write the shards to ``folder``.

    Null texts count as empty and hold the end id alone. Rows with a null key
    come first and can be read in order only. Rows of equal key are stored one
    after the other, ordered by text. An empty table gives a store of no shard.
    """
    vocabulary = path or vocabulary_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, shard = encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0
        keys, encoded, size = [], [], 0
        for batch in batches:
            for known, k, t in zip(batch["known"], batch["key"], batch["text"]):
                ids = enc.encode(t)
                keys.append(int(k) if known else None)
                encoded.append(ids)
                size += len(ids)
                if size >= SHARD_BYTES:
                    yield pd.DataFrame([shard_row(part, shard, keys, encoded)])
                    keys, encoded, size, shard = [], [], 0, shard + 1
        if keys:
            yield pd.DataFrame([shard_row(part, shard, keys, encoded)])

    rows = docs.select(
        key.isNotNull().alias("known"), F.coalesce(key.cast("long"), F.lit(0)).alias("key"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    order = ["known", "key", "text"]
    sorted_rows = rows.repartitionByRange("known", "key", F.xxhash64("text")).sortWithinPartitions(*order)
    sorted_rows.mapInPandas(encode, SCHEMA).write.parquet(folder)
    return docs.sparkSession.read.schema(SCHEMA).parquet(folder)


def read_back(store: DataFrame) -> DataFrame:
    """Every stored document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Rows with a key are found by way of the hash, the rest by their order.
    Starts are counts before a shard, summed over key ranges (one number each
    on the driver) and inside a range.
    """
    spark: SparkSession = store.sparkSession
    sums = store.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ahead, total = [], 0
    for p in parts:
        ahead.append((p["part"], total))
        total += p["n"]
    bases = spark.createDataFrame(ahead, "part long, base long")
    inside = F.sum("n").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(bases), "part").select(
        "part", "shard", (F.col("base") + F.col("inside")).alias("base")
    )

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.to_dict("records"):
                keys = np.frombuffer(shard["keys"], "<i8")
                known = np.frombuffer(shard["has_key"], np.uint8) == 1
                lengths = np.frombuffer(shard["lengths"], "<u4").astype(np.int64)
                start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                first, rows = lookup(shard, keys[known])
                if not (rows > 0).all():
                    raise ValueError("a stored key is not found")
                # the n-th row of a run of equal keys starts n - 1 rows after the first
                run = np.searchsorted(keys[known], keys[known], side="left")
                start[known] = first + (start[known] - start[known][run])
                ids = memoryview(shard["payload"])
                crc = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), lengths.tolist())]
                yield pd.DataFrame(
                    {
                        "part": shard["part"], "shard": shard["shard"],
                        "doc_id": pd.array(np.where(known, keys, 0), dtype="Int64"),
                        "known": known, "within": start, "n_tokens": lengths, "ids_crc32": crc,
                    }
                )

    found = store.mapInPandas(
        places, "part long, shard long, doc_id long, known boolean, within long, n_tokens long, ids_crc32 long"
    )
    return found.join(starts, ["part", "shard"]).select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
        (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32",
    )


def query(docs: DataFrame) -> DataFrame:
    """Write all documents to a store in the shared folder and read them back from it."""
    folder = session.new_table_path(docs.sparkSession, "token-store")
    return read_back(write_store(docs, F.col("doc_id"), F.col("text"), folder))
