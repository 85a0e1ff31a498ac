"""Near copies, repeated passages and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import parityjoin, repeats
from recordloom.llm.components import components

from .conftest import clashing


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def joined(texts):
    """Smallest key of each component, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    top = {k: k for k in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders, common = defaultdict(list), defaultdict(int)
    for k, s in sorted(sets.items()):
        for g in s:
            for o in holders[g]:
                common[o, k] += 1
            holders[g].append(k)
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def families(seed=5):
    """Families of edited copies around the threshold, with a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out, key = {}, 0
    for length in (4, 5, 9, 24, 60, 150, 400):
        for _ in range(4):
            base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
            if length >= 60:
                base[10:10] = passage
            for _ in range(12):
                words = list(base)
                for _ in range(rng.choice([0, 1, max(1, length // 60), max(1, length // 40)])):
                    words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
                out[key] = " ".join(words)
                key += 1
    return out


@pytest.mark.parametrize("small", [64, 3])
def test_components_match_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(parityjoin, "SMALL_GROUP", small)
    monkeypatch.setattr(parityjoin, "TILE", 8)
    texts = families()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parityjoin.query(clashing(docs, "id", "parts")).collect()}
    assert got == joined(texts)


def test_text_at_the_threshold_of_a_tight_family(spark):
    """It links with one member, not the smallest id, and all their equal parts are crowded."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(409)]  # 405 shingles: nine words edited apart from each other give 360 / 450

    def parts(words):
        s = parityjoin.shingle_set(next(parityjoin.word_hashes([" ".join(words).encode()])), 5)
        return [set(parityjoin.part_values(s, n).tolist()) for n in (parityjoin.scheme(len(s)), parityjoin.scheme(len(s)) - 1)]

    def edited(places, tag):
        return [f"{tag}x{i}" if i in places else w for i, w in enumerate(base)]

    texts = {i: " ".join(edited({4 + 3 * i}, f"m{i}")) for i in range(120)}
    texts[120] = " ".join(base)
    whole, far, tried = parts(base), 0, 0
    while far < 3:
        places = {30 + 39 * i + 3 * rng.randrange(10) for i in range(9)}  # words that no member edits
        words = edited(places, f"f{tried}")
        tried += 1
        if all(len(own - of_base) >= 30 for own, of_base in zip(parts(words), whole)):
            texts[1000 + far] = " ".join(words)
            far += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = joined(texts)
    assert {c for _, c in want.values()} == {0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in parityjoin.query(docs).collect()} == want


def test_given_documents_and_odd_ones(documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parityjoin.query(documents).collect()}
    assert got == joined(texts)


def test_null_keys_and_no_rows(spark, empty):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, parityjoin.query(docs).collect()), key=str)
    assert got == [(1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert parityjoin.query(empty).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m, both in ((50, 60, 45), (300, 900, 200), (1, 1, 0), (2000, 1900, 1800)):
        pool = np.unique(rng.integers(0, 1 << 63, n + m + 10, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
        difference = len(np.setxor1d(a, b))
        assert parityjoin.hamming(parityjoin.bit_sketch(a), parityjoin.bit_sketch(b)) <= difference


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top if find(x) != x}


def cut(texts):
    """Kept bytes, removed bytes and runs of each text, from all 200-byte strings."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = defaultdict(int)
    for b in data.values():
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] += 1
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("few", [1024, 2])
def test_repeats_match_all_substrings(spark, documents, few, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", few)
    rng = random.Random(9)
    block = "".join(rng.choice("abcdefg hij") for _ in range(700))
    texts = {r.doc_id: r.text for r in documents.where("doc_id < 60 or doc_id > 10008 or doc_id < 10004 and doc_id > 10000").collect()}
    for i in range(30):  # pieces of one passage, of 150 to 400 bytes, in other surroundings
        at, n = rng.randrange(300), rng.randrange(150, 400)
        texts[20_000 + i] = f"{rng.random()} " + block[at : at + n] + f" {rng.random()}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.query(clashing(docs, "key", "spans")).collect()}
    assert got == cut(texts)


def test_repeated_rows_and_no_rows(spark, empty):
    docs = spark.createDataFrame([(1, "q" + "z" * 10 + "ab c" * 60)] * 2 + [(None, None)], "doc_id long, text string")
    got = sorted(map(tuple, repeats.query(docs).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert got == [(1, 251, 251), (1, 251, 251), (None, 0, 0)]
    assert repeats.query(empty).count() == 0
