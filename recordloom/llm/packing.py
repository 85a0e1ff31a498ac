"""Packing documents into windows, each filled with lexically near documents.

Documents stand in shards of bounded size. A shard holds a BM25 inverted index
over token ids; the document that opens a window is its seed, and the unused
documents with the highest BM25 score for the seed's heaviest terms follow it;
when those find no more, the seed's next terms are asked, block by block.
A document that crosses the end of a window is cut there and its rest opens the
next window. What is left at the end of a shard is cut into windows whose sizes
are powers of two, largest first, so nothing is padded whatever the number of
shards. Every id is placed exactly once. Shards are the consecutive rows of an input split, so nothing is
shuffled, and a lost task is redone from its split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tokens import END_ID, encoder, vocabulary_path

WINDOW = 2048
SHARD_TOKENS = 1 << 20
QUERY_TERMS = 24
K1, B = 1.2, 0.75
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Bm25:
    """Inverted index of one shard."""

    def __init__(self, docs: list[np.ndarray]):
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found])
        terms = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        lengths = np.array([len(d) for d in docs], np.float64)
        count = np.bincount(terms)
        idf = np.log1p((len(docs) - count + 0.5) / (count + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[owner])
        weight[count[terms] == 1] = 0.0  # a term of one document finds nothing
        self.n, self.terms, self.weight = len(docs), terms, weight
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms.astype(np.uint16) if len(count) <= 1 << 16 else terms, kind="stable")
        self.owner, self.posted = owner[order], weight[order]
        self.heads = np.concatenate([[0], np.cumsum(count)])

    def blocks(self, seed: int) -> list[np.ndarray]:
        """Places of the seed's terms that can find others, heaviest first, in blocks."""
        lo, hi = self.bounds[seed], self.bounds[seed + 1]
        order = lo + np.argsort(-self.weight[lo:hi], kind="stable")
        order = order[self.weight[order] > 0]
        return [order[i : i + QUERY_TERMS] for i in range(0, len(order), QUERY_TERMS)]

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64, block: np.ndarray | None = None) -> np.ndarray:
        """Unused documents by score for a block of the seed's terms (the first), best first; ties by place."""
        if block is None:
            block = next(iter(self.blocks(seed)), np.empty(0, np.int64))
        spans = [(self.heads[t], self.heads[t + 1]) for t in self.terms[block]]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(
            np.concatenate([self.owner[a:b] for a, b in spans]),
            np.concatenate([self.posted[a:b] for a, b in spans]), minlength=self.n,
        )
        score[used] = 0.0
        near = np.flatnonzero(score)
        if len(near) > most:  # the window takes a few; what is left over is asked for again
            near = near[np.argpartition(-score[near], most)[:most]]
        return near[np.lexsort((near, -score[near]))]


def evened(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces with a short last sequence cut into sequences whose sizes are powers of two."""
    last = pieces[-1][3]
    head = len(pieces)
    while head and pieces[head - 1][3] == last:
        head -= 1
    left = sum(p[2] for p in pieces[head:])
    if left == window:
        return pieces
    out, sequence, offset, size = pieces[:head], last, 0, 1 << left.bit_length() - 1
    for doc, start, length, _, _ in pieces[head:]:
        while length:
            take = min(length, size - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, left, offset = start + take, length - take, left - take, offset + take
            if offset == size and left:
                sequence, offset, size = sequence + 1, 0, 1 << left.bit_length() - 1
    return out


def fill(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of one shard: (document, start, length, sequence, offset)."""
    index = Bm25(docs)
    used = np.zeros(len(docs), bool)
    pieces, sequence, offset, fresh = [], 0, 0, 0
    queue: list[int] = []
    blocks: list[np.ndarray] | None = []  # terms of the seed not yet used up, heaviest last; None: not asked yet
    seed = -1
    for _ in range(len(docs)):
        while queue and used[queue[-1]]:
            queue.pop()
        if not queue and blocks is None:
            blocks = index.blocks(seed)[::-1]
        while not queue and blocks:
            queue = index.neighbours(seed, used, block=blocks[-1])[::-1].tolist()
            if not queue:
                blocks.pop()
        if queue:
            doc = queue.pop()
        else:
            while used[fresh]:
                fresh += 1
            doc = fresh
        used[doc] = True
        if offset == 0:
            seed, queue, blocks = doc, [], None
        start, left = 0, len(docs[doc])
        while left:
            take = min(left, window - offset)
            pieces.append((doc, start, take, sequence, offset))
            start, left, offset = start + take, left - take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0
                seed, queue, blocks = doc, [], None
    return evened(pieces, window)


def pack(
    docs: DataFrame, key: Column, text: Column, *, window: int = WINDOW, path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents: key, place in its document, CRC of its ids, sequence and offset.

    Null and empty texts hold the end id alone. Rows of equal or null key are
    documents of their own. Sequences are filled from offset 0 without gaps.
    An empty table gives no pieces.
    """
    vocabulary = path or vocabulary_path()

    def shard_pieces(keys: list, encoded: list[bytes], first: int) -> pd.DataFrame:
        ids = [np.frombuffer(e, "<u4") for e in encoded]
        doc, start, length, sequence, offset = map(np.array, zip(*fill(ids, window)))
        crc = [zlib.crc32(memoryview(encoded[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc, start, length)]
        sizes = np.array([len(i) for i in ids])
        return pd.DataFrame(
            {
                "doc_id": pd.array([keys[d] for d in doc], dtype="Int64"), "start": start, "length": length,
                "ids_crc32": crc, "doc_tokens": sizes[doc], "sequence_id": first + sequence, "offset": offset,
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, first = encoder(vocabulary, end_id), TaskContext.get().partitionId() << 32
        keys, encoded, size = [], [], 0
        for batch in batches:
            for known, k, t in zip(batch["known"], batch["key"], batch["text"]):
                keys.append(int(k) if known else None)
                encoded.append(enc.encode(t))
                size += len(encoded[-1]) // 4
                if size >= SHARD_TOKENS:
                    out = shard_pieces(keys, encoded, first)
                    first += int(out["sequence_id"].iloc[-1]) - first + 1
                    keys, encoded, size = [], [], 0
                    yield out
        if keys:
            yield shard_pieces(keys, encoded, first)

    rows = docs.select(
        key.isNotNull().alias("known"), F.coalesce(key.cast("long"), F.lit(0)).alias("key"), text.alias("text")
    )
    return rows.mapInPandas(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    """Pieces of every document."""
    return pack(docs, F.col("doc_id"), F.col("text"))
