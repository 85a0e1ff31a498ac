"""Quality rules and source mix against plain Python."""

import re
from collections import Counter, defaultdict

from .conftest import clashing
from pyspark.sql import functions as F

from recordloom.llm import mixing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_rules_match_plain_counts(documents, texts):
    got = rules.query(clashing(documents, "words", "row", "n_words")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rules_turn_away_noise_and_keep_prose(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    joined = rules.query(documents).join(labels, "doc_id")
    good = joined.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.98 * good.count()
    noise = documents.where("doc_id < 8").withColumn("text", F.regexp_replace("text", r"(\S+)", "$1###%%%"))
    many = rules.quality_rules(documents.unionByName(noise.withColumn("doc_id", F.col("doc_id") + 50_000)), F.col("text"), F.col("lang"))
    marked = many.where("row.doc_id >= 50000 and n_words >= 50")
    assert marked.where("kept").count() == 0 < marked.count()


def test_rules_on_an_empty_table_and_without_languages(documents, empty):
    assert rules.query(empty).count() == 0
    unknown = rules.query(documents.withColumn("lang", F.lit(None).cast("string")))
    assert unknown.where("kept = base_failed").count() == 0


def plain_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * len(sizes)))
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        level = left / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= over


def test_mix_meets_its_targets(documents):
    got = mixing.query(clashing(documents, "row", "target")).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, mixing.query(documents.repartition(5)).collect())) == sorted(map(tuple, got))


def test_emitted_rows_follow_copies(documents, empty):
    mix = mixing.systematic_mix(documents, F.col("text"), F.col("source"), F.col("doc_id"))
    copies = {r.doc_id: r.copies for r in mix.select("row.doc_id", "copies").collect()}
    emitted = Counter(r.doc_id for r in mixing.emit(mix).collect())
    assert emitted == Counter({k: v for k, v in copies.items() if v})
    assert mixing.emit(mix).columns == documents.columns
    assert mixing.query(empty).count() == 0
