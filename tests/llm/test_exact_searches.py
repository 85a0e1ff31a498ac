"""Pivot-table search, LAESA codes and dual-tree search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import dualtree, laesacodes, pivottable

from .conftest import clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(1024 * float(x)) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vector_rows(n=900, size=12, seed=5):
    """Clustered vectors, copies, ties, odd ones and other lengths."""
    rng = np.random.default_rng(seed)
    m = np.float32(rng.normal(size=(n, size)) + 2 * rng.normal(size=(9, size))[rng.integers(0, 9, n)])
    m[200:300] = m[200]
    m[300:320] *= np.float32(30)
    m[320] = 0
    rows = [(i, [float(x) for x in v], None if i % 11 == 0 else int(i % 3)) for i, v in enumerate(m)]
    odd = [None, [None] * size, [float("nan")] * size, [float("inf")] + [0.0] * (size - 1)]
    for i, v in enumerate(odd):
        rows[400 + i] = (400 + i, v, 1)
    return rows


def best_scores(rows, k=10, step=100):
    kept = [(i, whole(v)) for i, v, *_ in rows if i is not None and good(v)]
    out = []
    for q, a in kept:
        if q % step == 0:
            found = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b)
            )[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_pivot_search_equals_brute_force(spark):
    rows = vector_rows() + [(1000 + i, [0.5 * i, -1.0], None) for i in range(7)] + [(1100, [], None), (1101, [], None), (None, [1.0] * 12, 2)]
    table = clashing(spark.createDataFrame(rows, VECTORS), "v", "q", "near", "block")
    asked = F.col("vec_id") % 100 == 0
    for block_rows in (None, 130):
        got = pivottable.highest(table, F.col("vec_id"), F.col("embedding"), asked, block_rows=block_rows)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == best_scores(rows)


def test_pivots_spare_most_evaluations():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 3000
    v = np.round(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 40)
    longest = float((v * v).sum(1).max())
    pivots = pivottable.Pivots(list(v[:500]), longest, 32)
    near = pivots.distances(v, pivots.lift(v))
    asks = pivots.distances(v[:1], np.zeros(1))[0]
    import pandas as pd

    block = pivottable.Block(pd.DataFrame({"id": np.arange(4000), "v": list(v), "near": list(near)}), longest, 10)
    ids, scores = block.best(0, v[0], asks, None)
    want = np.lexsort((np.arange(4000), -(v @ v[0])))
    want = want[want != 0][:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == (v @ v[0])[want].tolist()
    place, _ = block.bounds(block.parts[8][2], asks, float(v[0] @ v[0]), float(scores[-1]))
    assert len(place) < 1500 and set(want) <= set(place)


def test_pivot_search_on_large_numbers_repeated_ids_and_few_rows(spark):
    huge = [(100 * i, [3.0e4 * (i + 1), -6.0e4, 1e30 if i == 2 else 1.0], None) for i in range(4)]
    ask = lambda rows: sorted(map(tuple, pivottable.query(spark.createDataFrame(rows, VECTORS)).collect()))
    edge = 1 << 26
    clipped = [(i, [max(-edge, min(edge, x)) / 1024 for x in whole(v)], None) for i, v, _ in huge]
    assert ask(huge) == best_scores(clipped)
    twice = [(0, [2.0, 1.0], None), (0, [1.0, 1.0], None), (0, [1.0, 1.0], 3), (1, [1.0, 0.0], None), (100, [0.0, 1.0], None)]
    assert ask(twice) == best_scores([twice[1], *twice[3:]])
    assert ask([]) == [] and ask([(0, [1.0], None)]) == [] and ask([(0, None, None)]) == []
    assert ask([(0, [1.0], None), (1, [2.0], None)]) == [(0, 1, 1, 2 * 1024 * 1024)]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((i, whole(v), label) for i, v, label in rows if good(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    out = [["", 0] for _ in kept]
    books = []
    for p in range(parts):
        x = np.array([v[p * size // parts : (p + 1) * size // parts] for _, v, _ in kept], np.int64).reshape(len(kept), -1)
        book = x[:entries].copy()
        for r in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            code = d.argmin(1)
            if r < rounds:
                for e in set(code.tolist()):
                    mine = x[code == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        for i, c in enumerate(code):
            out[i] = [out[i][0] + f"{c:02x}", out[i][1] + int(d[i, c])]
        books.append(book)
    total = Counter()
    for (_, _, label), (_, error) in zip(kept, out):
        total[label] += error
    digest = hashlib.sha256(",".join(str(z) for b in books for z in b.ravel()).encode()).hexdigest()
    return sorted(((i, code, e, total[label], digest) for (i, _, label), (code, e) in zip(kept, out)), key=repr)


def coded(spark, rows):
    return sorted(map(tuple, laesacodes.query(clashing(spark.createDataFrame(rows, VECTORS), "v", "id", "near", "code")).collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rows = vector_rows(700) + [(2000, [1.0], 1), (None, [0.25] * 12, 1), (5, [0.5] * 12, None), (5, [0.5] * 12, None)]
    assert coded(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("rows", [
    [(3, [1.0, -2.0, 0.3], None), (9, [1.0, -2.0, 0.3], None), (4, [0.0, 0.0, 0.0], 7)],
    [(1, [], 1), (2, [], 1)],
    [(1, [0.1] * 8, 1)],
])
def test_codes_of_few_and_short_rows(spark, rows):
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_empty_tables(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1), (2, [None], 1)]) == []


def test_label_sums_without_broadcast(spark, monkeypatch):
    rows = vector_rows(450, size=4)
    monkeypatch.setattr(laesacodes, "BROADCAST_ROW_LIMIT", 1)
    assert coded(spark, rows) == plain_codes(rows)


def test_pruned_entries_are_never_nearest():
    rng = np.random.default_rng(4)
    entries, parts = rng.integers(-500, 500, (256, 16)), rng.integers(-500, 500, (600, 16))
    entries[17] = entries[3]  # equal entries: the lower index wins
    parts[5] = entries[17]
    pivots = entries[:10]
    near = np.sqrt(laesacodes.squared_distances(parts[:, None], pivots[None]).astype(float))
    code, error = laesacodes.Codebook(entries, pivots).assign(parts, near)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all() and code[5] == 3


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, k=50):
    bags = [(i, words(t)) for i, t in docs if i is not None and t is not None]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    n_docs, n_words = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for *_, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(words(text)) if t in c
            )
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def ranking(docs, items, **more):
    got = dualtree.ranked(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), **more)
    return sorted(map(tuple, got.collect()), key=repr)


def item_rows(texts):
    given = [" ".join((t or "").split()[:30]) for t in list(texts.values())[:60]]
    odd = [None, "", "  ", "!!! ...", "zzzqqq", given[0], "é😀 A@B.co Ünï", "w1x1 w2x2 W3X3", "the", "x" * 200]
    return [(i, t) for i, t in enumerate(given + odd)] + [(3, "de la en"), (None, "and the")]


def test_dual_tree_equals_brute_force(spark, documents, texts, monkeypatch):
    items = item_rows(texts)
    more = [(5, "copy of words and the words"), (5, "copy of words and the words"), (None, "and the"), (-7, "and the and the")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    plain = [*texts.items(), *more]
    table = clashing(spark.createDataFrame(items, "item_id long, text string"), "number", "part")
    want = plain_ranking(plain, items)
    assert ranking(clashing(docs, "key", "n", "terms", "score"), table) == want
    assert ranking(docs, table, k=3) == plain_ranking(plain, items, k=3)
    monkeypatch.setattr(dualtree, "SET_CHARS", 4000)  # several sets of items
    monkeypatch.setattr(dualtree, "ITEM_CELLS", 2000)  # and blocks of them
    assert ranking(docs, table) == want


def test_node_bounds_prune_and_never_lose():
    rng = np.random.default_rng(6)
    items = [np.unique(rng.integers(0, 300, 12)) for _ in range(40)]
    tree = dualtree.Items(list(range(40)), items, {t: int(rng.integers(1, 9000)) for t in range(300)})
    best, truth, scored = dualtree.Best(40, 5), [], 0
    for batch in range(6):
        keys = np.arange(batch * 512, batch * 512 + 512)
        doc = np.repeat(np.arange(512), 10)
        term = np.concatenate([rng.choice(len(tree.terms), 10, replace=False) for _ in keys])
        gain = tree.weights[term] * rng.integers(1, 900, len(term))
        rows = np.zeros((512, len(tree.terms)), np.int64)
        rows[doc, term] = gain
        truth.append(rows @ tree.holds.astype(np.int64).T)
        scored += dualtree.search_batch(tree, best, keys, doc, term, gain)
    truth = np.concatenate(truth)
    for item in range(40):
        order = np.lexsort((np.arange(len(truth)), -truth[:, item]))[:5]
        want = [(int(i), int(truth[i, item])) for i in order if truth[i, item] > 0]
        mine = best.item == item
        assert list(zip(best.key[mine].tolist(), best.score[mine].tolist())) == want
    assert scored < 0.7 * truth.size  # pairs under pruned nodes are never scored


def test_dual_tree_on_empty_tables(spark, documents, empty):
    items = spark.createDataFrame([(1, "and the")], "item_id long, text string")
    assert ranking(empty, items) == []
    assert ranking(documents, items.where("false")) == []
    assert ranking(documents, spark.createDataFrame([(1, None), (2, "?")], "item_id long, text string")) == []
    assert dualtree.query(empty, items).columns == ["item_id", "rank", "doc_id", "score"]
