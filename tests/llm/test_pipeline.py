"""The pipeline stage by stage, each judged on its own input."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from recordloom.llm import pii
from recordloom.llm.shared import staged

from .test_duplicates import joined

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], FOLDER), name))
    start, good, single, clean, mixed, packed = tables
    for t in (good, single, clean, mixed):
        assert t.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    gone = {r.doc_id for r in start.collect()} - kept
    assert sum(labels.get(k) == 1 for k in gone) <= 2 and sum(labels.get(k) == 0 for k in kept) <= 2
    texts = {r.doc_id: r.text for r in good.collect()}
    assert {r.doc_id for r in single.collect()} == {c for _, c in joined(texts).values()}
    found = pii.detect(clean, F.col("text"))
    assert found.where("size(base) > 0").count() == 0 and clean.count() == single.count()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r.doc_id for r in clean.collect()}
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(copies)
    per_copy = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert all(tokens[k] == n * per_copy[k] for k, n in copies.items())


def test_every_operator_is_registered():
    names = [n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()
