"""Token store and packing: exact round trips against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import packing, tokens, tokenstore

from .conftest import clashing


@pytest.fixture(scope="module")
def ids(texts):
    plain = tokens.Encoder(tokens.vocabulary_path()).tokenizer
    encode = lambda t: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    return {k: encode(t) for k, t in texts.items()}


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", 300)
    enc, rng = tokens.Encoder(tokens.vocabulary_path()), random.Random(3)
    signs = [*"abzABZ019 '’!$.,;:#&<|>_\n\t\"`~^[]{}\\\v\f\r", *"éßÿ÷×ÀÞİǆΣςﬁ漢😀µªº½٣", "\u0301", "\xa0", "\u2028", "\x00", "\x1c", "\x7f", "\x85",
             "'s", "'LL", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "Élan", "don't"]
    for size in [*[12] * 20_000, *[400] * 100]:
        text = "".join(rng.choices(signs, k=rng.randint(0, size)))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == np.array([*want, 1], "<u4").tobytes(), text


def test_store_gives_back_all_ids(documents, ids):
    got = {r.doc_id: r for r in tokenstore.query(clashing(documents, "key", "part")).collect()}
    start = 0
    for k in sorted(ids):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    assert len(got) == len(ids)


def test_store_with_null_and_repeated_keys(spark, empty, tmp_path):
    rows = [(None, "a"), (5, "b b"), (5, "a"), (None, None), (-3, "c"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = tokenstore.write_store(docs, F.col("doc_id"), F.col("text"), str(tmp_path / "s"))
    got = sorted(tokenstore.read_back(store).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (None, 2), (-3, 2), (5, 2), (5, 2), (5, 3)]
    assert [r.start for r in got] == [0, 1, 3, 5, 7, 9]
    assert tokenstore.query(empty).count() == 0


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    hashed = tokenstore.PerfectHash.build(keys)
    assert sorted(hashed.values(keys)) == list(range(len(keys)))
    row = tokenstore.shard_row(0, 0, keys.tolist(), [b"\x01\0\0\0"] * len(keys))
    first, rows = tokenstore.lookup(row, keys)
    assert (rows == 1).all() and sorted(first) == list(range(len(keys)))
    assert (tokenstore.lookup(row, keys + 1)[1] == 0).all()


@pytest.mark.parametrize("shard", [1 << 20, 5000])
def test_packing_places_every_id_once(documents, ids, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    pieces = packing.query(clashing(documents, "key", "known")).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for k, mine in by_doc.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(ids[k][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[k])
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == packing.WINDOW or at & (at - 1) == 0  # never padded


def test_neighbours_share_rare_terms():
    rng = np.random.default_rng(2)
    docs = [np.concatenate([rng.integers(2000, 60_000, 30), np.full(5, 1000 + i // 2)]).astype("<u4") for i in range(20)]
    index = packing.Bm25(docs)
    for i in range(20):
        used = np.zeros(20, bool)
        used[i] = True
        assert index.neighbours(i, used)[0] == i ^ 1


def test_later_terms_of_a_seed_find_neighbours():
    """Document 0 shares 30 heavy terms with 3, and only a light one, past QUERY_TERMS, with 4."""
    rare = np.repeat(np.arange(100, 130), 3)
    docs = [np.concatenate([rare, [7]]), np.arange(500, 591), np.arange(600, 691), np.concatenate([rare, np.arange(700, 701)]),
            np.concatenate([np.arange(800, 890), [7]])]
    docs = [d.astype("<u4") for d in docs]
    order = list(dict.fromkeys(p[0] for p in packing.fill(docs, 10_000)))
    assert order == [0, 3, 4, 1, 2]


@pytest.mark.parametrize("sizes", [[1], [2047], [2048], [2049], [1, 1, 1], [3000, 5, 1301], [7] * 900])
def test_ends_of_shards_are_powers_of_two(sizes):
    docs = [np.full(n, 9 + i, "<u4") for i, n in enumerate(sizes)]
    filled = {}
    for doc, start, length, sequence, offset in packing.fill(docs, 2048):
        assert filled.get(sequence, 0) == offset and length > 0
        filled[sequence] = offset + length
    assert sum(filled.values()) == sum(sizes) and sorted(filled) == list(range(len(filled)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    assert sum(n < 2048 for n in filled.values()) <= 11


def test_packing_of_nothing(empty):
    assert packing.query(empty).count() == 0
