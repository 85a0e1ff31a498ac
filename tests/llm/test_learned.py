"""Personal data, quality scores, URL rules and graph search."""

import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import graphsearch, pii, preference, urls
from recordloom.llm.shared import running

from .conftest import clashing

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain_spans(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_spans_match_plain_patterns(spark, documents, texts):
    odd = [
        "a@b.c_d@e.f x@y..z@q.r", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1", "+12+3456789012 ++49 30 1234567 +4", "a@" * 500,
        "1." * 500, "1" * 2000, "4111-1111-1111-1111x 79927398713 378282246310005 3782 822463 10005", "a" * 3000 + "@b.c",
    ]
    more = spark.createDataFrame([(30_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    want = {k: plain_spans(t) for k, t in {**texts, **{30_000 + i: t for i, t in enumerate(odd)}}.items()}
    for r in pii.query(clashing(docs, "row", "found", "spans")).collect():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest(), want[r.doc_id]
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, want[r.doc_id].split(","))) <= set(spans)
        assert (r.n_email, r.n_phone) == (want[r.doc_id].count("email"), want[r.doc_id].count("phone"))


def test_reliable_labelers_outvote_a_noisy_one():
    counts = [(0, (1, 1, 1), 50), (0, (1, 1, -1), 50), (0, (-1, -1, 1), 60), (0, (-1, -1, -1), 60)]
    truth = pii.reliabilities(counts)
    assert truth[0, (1, 1, -1)] > 0.9 > 0.1 > truth[0, (-1, -1, 1)]


def test_masking(spark, empty):
    docs = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4 é", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.mask(docs, "text").collect()}
    assert got == {1: ("mail <email> or <ip> é", "x"), 2: (None, "y"), 3: ("", None)}
    assert pii.query(empty).count() == 0 and pii.mask(empty, "text").count() == 0


def test_running_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(0, 50, n)]) for i, n in enumerate([0, 1, 2, 127, 128, 129, 256, 257, 1000])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = df.select("i", running(F.col("v"), lambda x, y: x + y, "int").alias("s"), running(F.col("v"), lambda x, y: F.greatest(x, y), "int").alias("m")).collect()
    for r in got:
        v = np.array(rows[r.i][1], int)
        assert r.s == np.cumsum(v).tolist() and r.m == np.maximum.accumulate(v).tolist()


def wide_texts(n=400, seed=12):
    """Texts with one planted wide span each, or one decoy: (text, kind, start, end or None)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def card():
        body = "4" + digits(14)
        for last in "0123456789":
            if passes("card", body + last):
                return body + last

    out = []
    for i in range(n):
        before, after = (" ".join(word() for _ in range(rng.randint(2, 12))) for _ in range(2))
        sep = rng.choice(["-", ".", " "])
        end = rng.choice(["com", "org", "net", "de"])
        real = {
            "email": rng.choice([f"{word()} at {word()} dot {end}", f"{word()} (at) {word()}.{end}", f"{word()}[at]{word()}[dot]{end}"]),
            "phone": f"{rng.randint(2, 9)}{digits(2)}{sep}{rng.randint(2, 9)}{digits(2)}{sep}{digits(4)}",
            "ip": rng.choice(["[.]", "(.)", "[dot]"]).join(str(rng.randint(1, 250)) for _ in range(4)),
            "card": rng.choice([".", "/", "_"]).join((lambda c: [c[j : j + 4] for j in (0, 4, 8, 12)])(card())),
        }
        lead = {"email": "write to", "phone": "phone:", "ip": "server", "card": "visa card"}
        fake = {
            "email": f"{word()} at {word()}. {word().capitalize()}", "phone": f"{rng.randint(0, 1)}{digits(2)}-{digits(3)} {digits(4)}",
            "ip": "[.]".join(str(rng.randint(300, 900)) for _ in range(4)), "card": f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(2)}",
        }
        kind = rng.choice(list(real))
        if rng.random() < 0.5:
            head = f"{before} {lead[kind] if rng.random() < 0.7 else word()} "
            out.append((f"{head}{real[kind]} {after}", kind, len(head), len(head) + len(real[kind])))
        else:
            lead = rng.choice(["order", "version", "invoice", word()])
            text = real["phone"] if kind == "phone" and lead in ("order", "invoice") else fake[kind]
            out.append((f"{before} {lead} {text} {after}", kind, None, None))
    return out


def test_planted_wide_spans(spark, documents):
    planted = wide_texts()
    docs = spark.createDataFrame([(50_000 + i, t) for i, (t, *_) in enumerate(planted)], "doc_id long, text string")
    docs = docs.unionByName(documents.select("doc_id", "text"))
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in pii.query(docs).collect()}
    right = wrong = missed = 0
    for i, (text, kind, start, end) in enumerate(planted):
        base = plain_spans(text)
        added = [s.split(":") for s in got[50_000 + i] if s not in base.split(",")]
        hit = [k == kind and start is not None and int(a) < end and start < int(b) for k, a, b in added]
        right, wrong = right + any(hit), wrong + hit.count(False)
        missed += start is not None and not any(hit)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9, (right, wrong, missed)
    more = ["order 212-555-0147 shipped", "please write to anna at mail dot com today", "they looked at houses. Then"]
    asked = docs.unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    told = {r.doc_id: r.spans for r in pii.query(asked).where("doc_id >= 90000").collect()}
    assert told == {90_000: "", 90_001: f"email:{more[1].index('anna')}:{more[1].index(' today')}", 90_002: ""}


def test_texts_full_of_matches_cost_as_much_as_plain_ones(spark):
    def seconds(text):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        row = pii.query(docs).collect()[0]
        masked = pii.mask(docs, "text").collect()[0].text
        return time.time() - start, row, masked

    n = 100_000
    seconds("1.2.3.4 a@b.co")
    plain, row, masked = seconds("abcdefg " * n)
    assert row.spans == "" and masked == "abcdefg " * n
    full, row, masked = seconds("1.2.3.4 " * n)
    assert row.n_ip == n and masked == "<ip> " * n
    assert full < 2 * plain + 8, (full, plain)
    both, row, masked = seconds("é@ü a@b.co +49 30 1234567 anna (at) mail.com " * (n // 10))
    assert (row.n_email, row.n_phone) == (n // 10, n // 10) and both < 2 * plain + 12, (both, plain)


def test_overlapping_spans_are_masked_once(spark):
    rows = [("abcdefghij", [(0, 0, 4), (2, 1, 6), (6, 2, 8)]), ("é😀ab", [(1, 1, 2)]), ("xyz", []), ("abcdefghij", [(0, 0, 9), (1, 1, 2), (3, 2, 10)])]
    for limit in (4_000_000, 0):
        pii.LETTERS_BEYOND = limit
        df = spark.createDataFrame(rows, "t string, s array<struct<start:int,kind:int,end:int>>")
        got = [r[0] for r in df.select(pii.masked(F.col("t"), F.col("s"))).collect()]
        assert got == ["<email><card>ij", "é<ip>ab", "xyz", "<email>"]
    pii.LETTERS_BEYOND = 4_000_000


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    joined = preference.query(clashing(docs, "key", "score"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in joined]) >= 0.95
    low = [r.score for r in joined if r.quality == 0]
    high = [r.score for r in joined if r.quality == 1]
    assert np.mean([[h > w for w in low] for h in high]) >= 0.98


def test_quality_without_labels_and_without_documents(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in preference.query(documents, none).collect()} == {(0.5, 1)}
    one = documents.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in preference.query(documents, one).collect()} == {1.0}
    assert preference.query(empty, one).count() == 0


def test_scores_of_odd_texts_are_numbers(documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = preference.query(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)


def plain_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    odd = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://a.net", "x://b.net/?q", "http://example.com/de/x?y#z", "http://notexample.com/de/x",
           "http://org/fr/", "://é.ORG/fr/É", "a://b://c.net/", "http://h\n.net/p\nq"]
    given = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame(list(enumerate(odd + given)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for r in urls.query(clashing(pages, "key", "tokens"), labels).collect():
        host, path, rule, verdict = plain_rule((odd + given)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_mined_rules_find_planted_tokens(spark):
    rows = [(i, f"http://s{i % 7}.com/{'casino' if i % 5 == 0 else 'news'}/{i}?id={i}") for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(350)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.query(pages, labels).collect()}
    assert got == {i: "block" if i % 5 == 0 else "allow" for i in range(700)}
    none = labels.where("false")
    assert urls.query(pages, none).where("verdict = 'block'").count() == 0
    assert urls.query(pages.where("false"), labels).count() == 0


def test_mining_long_urls_stays_small(spark):
    """A URL of 200 words and 50 query keys alone, a template of them on 1 % of pages, and one with a word missing each."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    query = "&".join(f"k{w}=1" for w in words[:50])
    long_ = "http://long.com/" + "/".join(words) + "?" + query
    rows = [(i, f"http://s{i % 7}.com/{'casino' if i % 5 == 0 else 'news'}/p?id={i}") for i in range(2000)]
    rows[3] = (3, "http://alone.com/" + "/".join(f"x{w}" for w in words) + "?" + query.replace("k", "q"))
    for i in range(20):
        rows[40 + 5 * i] = (40 + 5 * i, long_)
    for i in range(40):
        rows[1000 + 5 * i] = (1000 + 5 * i, "http://t.com/" + "/".join(f"y{w}" for j, w in enumerate(words[:24]) if j != i % 24))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    start = time.time()
    got = {r.page_id: r.verdict for r in urls.query(pages, labels).collect()}
    assert time.time() - start < 60
    assert got == {i: "block" if i % 5 == 0 else "allow" for i in range(2000)}


def test_tokens_of_one_item_match_alone(spark):
    rows = [(i, "http://a.com/red/blue" if i < 20 else "http://b.com/green") for i in range(60)]
    rows += [(100, "http://c.com/blue"), (101, "http://c.com/red/x"), (102, "http://c.com/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.query(pages, labels).collect()}
    assert (got[100], got[101], got[102]) == ("block", "block", "allow")


def test_graph_search_recall_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 24)) + rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] * 2
    vectors[100:400] = vectors[100]  # a large group of copies
    vectors[500] = 0
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    rows[600] = (600, None)
    rows[601] = (601, [float("nan")] * 24)
    rows[602] = (602, [None] * 24)
    rows[603] = (603, [float("inf")] + [0.0] * 23)
    rows.append((9000, []))
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "v", "ids")
    got = {}
    for r in graphsearch.nearest(table, F.col("vec_id"), F.col("embedding"), F.col("vec_id") % 50 == 0, shard_points=600).collect():
        got.setdefault(r.query_id, []).append(r)
    out = {500, 600, 601, 602, 603, 9000}
    ids = np.array([i for i, _ in rows if i not in out])
    m = np.array([rows[i][1] for i in ids])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        sims = unit @ unit[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -np.round(sims, 12))) if ids[i] != q][:5]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in mine}
        assert all(abs(r.score - sims[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in mine)
        if 100 <= q < 400:
            assert [r.vec_id for r in mine] == [i for i in range(100, 107) if i != q][:5]
        hits, total = hits + len({r.vec_id for r in mine} & set(ids[order])), total + 5
    assert set(got) == {int(q) for q in ids[ids % 50 == 0]} and hits >= 0.9 * total


@pytest.mark.parametrize("n", [0, 1, 3])
def test_graph_search_on_few_rows(spark, n):
    table = spark.createDataFrame([(50 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = graphsearch.query(table).collect()
    assert len(got) == n * (n - 1)


def test_fitting_pairs_needs_little_memory():
    """The differences of all pairs alone are 130 MB, three times over in one step."""
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(preference.NAMES)))
    good = x[:, 0] + 0.3 * rng.random(len(x)) > 0.5
    tracemalloc.start()
    model = preference.fit(x, good)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert ((model.raw(x) + model.shift > 0) == good).mean() > 0.8


def _wide_pages(spark, widths):
    """Labelled pages of words; only ``pair`` together with ``other`` is bad, behind words more typical of bad pages."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(24)]
    rows = []
    for i in range(600):
        some = rng.sample(words[:widths], rng.randint(widths // 2, widths))
        both = rng.sample(["pair", "other"], rng.randint(0, 2))
        rows.append((i, "http://s.com/" + "/".join(some + both), int(len(both) < 2 or rng.random() < 0.2)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    return pages, spark.createDataFrame([(i, q == 0) for i, _, q in rows], "key long, bad boolean")


def test_rules_of_levels_fit_like_all_sets(spark, monkeypatch):
    pages, labels = _wide_pages(spark, 6)
    judge = lambda: {(r.key, r.verdict, r.mined) for r in urls.url_filter(pages, F.col("page_id"), F.col("url"), labels).collect()}
    whole = judge()
    monkeypatch.setattr(urls, "WIDEST", 0)
    assert judge() == whole


def test_no_item_of_a_wide_page_is_left_out(spark):
    """A page of 14 items: what makes it bad is not among its 12 most typical ones of the whole table."""
    rows, bad = [], []
    words = [f"w{chr(97 + i)}" for i in range(13)]
    for i in range(130):
        # every word is missing from some bad page, so no two are one item; all are more typical of bad pages than ``mark``
        rows.append((i, "http://s.com/" + "/".join(w for j, w in enumerate(words) if j != i % 13) + "/mark/sign"))
        bad.append((i, True))
    for i in range(130, 530):
        rows.append((i, "http://s.com/" + ("mark" if i % 2 else "sign")))
        bad.append((i, False))
    rows += [(900, "http://s.com/mark/sign"), (901, "http://s.com/mark"), (902, "http://s.com/sign")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(bad, "key long, bad boolean")
    got = {r.key: r.verdict for r in urls.url_filter(pages, F.col("page_id"), F.col("url"), labels).collect()}
    assert (got[900], got[901], got[902]) == ("block", "allow", "allow")
