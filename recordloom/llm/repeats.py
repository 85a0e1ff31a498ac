"""Removing passages that occur more than once, by bucket refinement of suffixes.

A suffix matters only if its first 200 bytes start elsewhere too. Of all
suffixes, those at anchors stand for the rest: in every run of 200 bytes the
40-gram with the smallest hash (the leftmost of equal ones) is the anchor, so
equal runs have equal anchors at equal places, whatever stands around them.

1. First buckets: anchors by their 40-gram. Buckets of one drop out.
2. Anchors of a bucket that agree in all bytes which a run over them can hold
   (160 before, 200 after) are one class; a class of several is repeated as a
   whole and serves the others as one reference.
3. Buckets that still hold several classes are refined: bucket identifiers of
   earlier and later offsets split a bucket, halving the range of runs each
   time, until it holds few classes; those are compared run by run. A bucket
   for a single run needs no comparison at all.

No bucket stands in one task: counts are combined before the shuffle, and only
buckets of bounded size are gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import staged
from recordloom.llm.shingles import BASE, BYTE_WORDS, UNBASE, mix, powers

RUN = 200
GRAM = 40
REACH = RUN - GRAM
FEW = 2048
PLACE_BITS = 20


def prefix_sums(data: np.ndarray) -> np.ndarray:
    scaled = BYTE_WORDS[data] * powers(BASE, len(data))[: len(data)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled)])


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(UNBASE, len(sums))[start])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, 40-gram hash and context hash of every anchor of a text."""
    n = len(data)
    if n < RUN:
        empty = np.empty(0, np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = spans_hash(sums, at, at + GRAM)
    chosen = []
    block = 1 << (PLACE_BITS - 1)  # places inside a block fit the low bits, so ties go left
    low = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, n - RUN + 1, block):
        part = grams[begin : begin + block + REACH]
        keyed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = REACH + 1
        padded = np.full(-(-len(part) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(part)] = keyed
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        runs = len(part) - REACH
        least = np.minimum(behind[:runs], ahead[REACH : REACH + runs]) & low
        chosen.append(np.unique(least).astype(np.int64) + begin)
    place = np.unique(np.concatenate(chosen))
    first, last = np.maximum(place - REACH, 0), np.minimum(place + RUN, n)
    context = spans_hash(sums, first, last) + (place - first).astype(np.uint64) * np.uint64(1009) + (last - place).astype(np.uint64)
    return place, grams[place], mix(context)


def as_array(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, twin, text in zip(batch["key"], batch["twin"], batch["text"]):
                place, gram, context = anchors(as_array(text))
                out.append((np.full(len(place), key), np.full(len(place), twin), place, gram.view(np.int64), context.view(np.int64)))
            if out:
                yield pd.DataFrame(dict(zip(("key", "twin", "place", "gram", "context"), map(np.concatenate, zip(*out)))))

    return rows.mapInPandas(run, "key long, twin long, place long, gram long, context long")


def contexts(rows: DataFrame) -> DataFrame:
    """Bytes around the asked anchors, with zeros where the text ends; ``low`` and ``high`` bound the real runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for asked, text in zip(batch["asked"], batch["text"]):
                data = (text or "").encode()
                for a in asked:
                    p = a["place"]
                    left, right = data[max(0, p - REACH) : p], data[p : p + RUN]
                    out.append((a["gram"], a["context"], REACH - len(left), len(right) - GRAM, left.rjust(REACH, b"\0") + right.ljust(RUN, b"\0"), a["kinds"]))
            yield pd.DataFrame(out, columns=["gram", "context", "low", "high", "bytes", "size"])

    return rows.mapInPandas(run, "gram long, context long, low int, high int, bytes binary, size long")


def repeated_runs(members: list, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs (gram, context, first, last) of a bucket that another member has too."""
    data = np.frombuffer(b"".join(m["bytes"] for m in members), np.uint8).reshape(len(members), -1)
    sums = np.zeros((len(members), data.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_WORDS[data] * powers(BASE, data.shape[1])[: data.shape[1]], axis=1, out=sums[:, 1:])
    at = np.arange(lo, hi + 1)
    values = mix((sums[:, at + RUN] - sums[:, at]) * powers(UNBASE, data.shape[1])[at])
    low, high = np.array([m["low"] for m in members]), np.array([m["high"] for m in members])
    real = (at >= low[:, None]) & (at <= high[:, None])
    filler = mix(np.arange(values.size, dtype=np.uint64) + np.uint64(1)).reshape(values.shape)
    values = np.where(real, values, filler)
    order = np.argsort(values, axis=0, kind="stable")
    sorted_ = np.take_along_axis(values, order, 0)
    twin = np.zeros(values.shape, bool)
    same = sorted_[1:] == sorted_[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = np.zeros(values.shape, bool)
    np.put_along_axis(hit, order, twin, 0)
    hit &= real
    for m, row in zip(members, hit):
        edge = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
        for first, end in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            yield m["gram"], m["context"], lo + first, lo + end - 1


def refined(classes: DataFrame) -> DataFrame:
    """``gram``, ``context``, ``first``, ``last``: repeated runs of classes that share a first bucket."""
    found = None
    key = ["bucket", "lo", "hi"]
    nodes = classes.select("*", F.lit(0).alias("lo"), F.lit(REACH).alias("hi"), F.col("gram").alias("bucket"))
    members = F.collect_list(F.struct("gram", "context", "low", "high", "bytes")).alias("members")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for ms, lo, hi in zip(batch["members"], batch["lo"], batch["hi"]) for r in repeated_runs(list(ms), lo, hi)]
            yield pd.DataFrame(out, columns=["gram", "context", "first", "last"])

    while True:
        single = nodes.where("lo = hi").select("gram", "context", F.col("lo").alias("first"), F.col("hi").alias("last"))
        small = nodes.where((F.col("size") <= FEW) & (F.col("lo") < F.col("hi"))).groupBy(*key).agg(members)
        done = small.select("members", "lo", "hi").mapInPandas(compare, "gram long, context long, first int, last int").unionByName(single)
        done = staged(done, "repeated-runs")
        found = done if found is None else found.unionByName(done)
        large = nodes.where((F.col("size") > FEW) & (F.col("lo") < F.col("hi")))
        if large.isEmpty():
            return found
        # members that agree in all bytes of their runs are repeated there; one stands for them from here on
        alike = F.xxhash64(F.substring("bytes", F.col("lo") + 1, F.col("hi") - F.col("lo") + RUN), "low", "high")
        large = large.withColumn("alike", alike)
        groups = large.groupBy(*key, "alike").agg(F.count("*").alias("n"), F.min("context").alias("one"))
        large = staged(large.join(groups, [*key, "alike"]), "large-buckets")
        twins = large.where("n > 1").select(
            "gram", "context", F.greatest("lo", "low").alias("first"), F.least("hi", "high").alias("last")
        )
        found = found.unionByName(twins.where("first <= last"))
        large = large.where("context = one")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
        nodes = large.withColumn("half", F.explode(halves)).select(
            "gram", "context", "low", "high", "bytes", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi")
        )
        # a bucket identifier for the bytes that all runs of the half have in common
        core = F.substring("bytes", F.col("hi") + 1, F.col("lo") + RUN - F.col("hi"))
        nodes = nodes.where("hi >= low and lo <= high").withColumn("bucket", F.xxhash64("gram", core))
        sizes = nodes.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
        nodes = staged(nodes.join(sizes, key), "buckets")


ALL_RUNS = -1


def drop_repeats(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``row`` (key), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) of every row.

    A byte goes if a run of 200 bytes over it starts at any other place too, in
    the same text or another. Runs lie inside one text. Null texts are empty;
    texts under 200 bytes stay whole. Repeated rows are texts of their own, so
    both copies of a long text go. Null keys are kept as they are.
    """
    rows = docs.select(
        key.cast("long").alias("doc_id"), F.coalesce(key.cast("long"), F.lit(0)).alias("key"),
        F.xxhash64(key.cast("long"), text).alias("twin"), F.coalesce(text, F.lit("")).alias("text"),
    )
    found = anchor_rows(rows.select("key", "twin", "text"))
    buckets = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    shared = staged(found.join(buckets, "gram"), "shared-anchors")
    classes = staged(
        shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "twin", "place")).alias("one")), "anchor-classes"
    )
    mixed = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = classes.join(mixed, "gram").select("one.key", "one.twin", F.struct("one.place", "gram", "context", "kinds").alias("ask"))
    asked = asked.groupBy("key", "twin").agg(F.collect_list("ask").alias("asked"))
    # rows of equal key and text give a context twice; such a class is repeated anyway
    around = staged(contexts(rows.select("key", "twin", "text").join(asked, ["key", "twin"]).select("asked", "text")), "anchor-contexts")
    run = F.struct("first", "last")
    whole = classes.where("n > 1").select("gram", "context", F.array(F.struct(F.lit(ALL_RUNS).alias("first"), F.lit(ALL_RUNS).alias("last"))).alias("runs"))
    some = refined(around).join(classes.where("n = 1").select("gram", "context"), ["gram", "context"], "left_semi")
    some = some.groupBy("gram", "context").agg(F.collect_list(run).alias("runs"))
    spans = shared.join(whole.unionByName(some), ["gram", "context"]).select("key", "twin", F.struct("place", "runs").alias("span"))
    spans = spans.groupBy("key", "twin").agg(F.collect_list("span").alias("spans"))
    spans = staged(spans, "repeated-spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for known, key, text, spans in zip(batch["known"], batch["key"], batch["text"], batch["spans"]):
                data = as_array(text)
                steps = np.zeros(len(data) + 1, np.int32)
                for p, s in ((int(s["place"]), r) for s in (spans if spans is not None else ()) for r in s["runs"]):
                    if s["first"] == ALL_RUNS:
                        begin, end = max(0, p - REACH), min(len(data), p + RUN)
                    else:
                        begin, end = p - REACH + int(s["first"]), p - REACH + int(s["last"]) + RUN
                    if end - begin >= RUN:
                        steps[begin] += 1
                        steps[end] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = data[~gone].tobytes()
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((int(key) if known else None, len(data), int(gone.sum()), n_spans, kept, hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
            yield frame.astype({"doc_id": "Int64"})

    joined = rows.join(spans, ["key", "twin"], "left").select(F.col("doc_id").isNotNull().alias("known"), "key", "text", "spans")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    """What is removed from every document."""
    return drop_repeats(docs, F.col("doc_id"), F.col("text")).drop("kept")
