"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A labelled good text is preferred to a labelled low one. Pairs of the two give
a logistic loss on the difference of their features; its minimum is a linear
score. The score is shifted so that the share of labelled texts below the
threshold equals the share of low labels (a quantile of the training scores).

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, in the
order of a hash of the id); everything else runs over all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shingles import shingle_set, word_hashes

SAMPLE = 20_000
PAIRS = 60_000
BINS = 10
# Pairs whose differences stand in memory at once while fitting.
PAIR_BLOCK = 4096
THRESHOLD = 0.3
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]\\/=_~^@`+",
    "stop": b".,;:", "shout": b"!?", "space": b" \t\n\r\x0b\x0c", "line": b"\n", "quote": b"'\"()-",
}
_TABLE = np.array([[b in chars for chars in _KINDS.values()] for b in range(256)], float)
NAMES = (*_KINDS, "foreign", "n_words", "word_bytes", "line_words", "distinct", "top", "twice", "triples", "windows", "lines", "run")


def measures(texts: list[str | None]) -> np.ndarray:
    """One row of measures per text, none of which depends on anything but the text."""
    data = [(t or "").encode() for t in texts]
    out = np.zeros((len(data), len(NAMES)))
    for i, (raw, words) in enumerate(zip(data, word_hashes(data))):
        n = len(words)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(1, len(raw))
        _, often = np.unique(words, return_counts=True)
        lines = raw.split(b"\n")
        out[i] = (
            *(counts @ _TABLE / size), counts[128:].sum() / size, math.log1p(n), math.log1p(len(raw) / max(1, n)),
            math.log1p(n / len(lines)), len(often) / max(1, n), often.max(initial=0) / max(1, n),
            often[often > 1].sum() / max(1, n), len(shingle_set(words, 3)) / max(1, n - 2),
            len(shingle_set(words, 5)) / max(1, n - 4), len(set(lines)) / len(lines), counts.max(initial=0) / size,
        )
    return out


class Model:
    """Score of a text: a weight for each bin of each measure, and one for its value."""

    def __init__(self, edges: np.ndarray, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, shift: float):
        self.edges, self.centre, self.scale, self.weight, self.shift = edges, centre, scale, weight, shift

    def design(self, x: np.ndarray) -> np.ndarray:
        rows, wide = np.arange(len(x)), x.shape[1]
        out = np.zeros((len(x), wide * (BINS + 2)))
        out[:, :wide] = np.clip((x - self.centre) / self.scale, -5, 5)
        for j in range(wide):
            out[rows, wide + j * (BINS + 1) + np.searchsorted(self.edges[j], x[:, j])] = 1
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weight

    def score(self, texts: list[str | None]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.raw(measures(texts)) + self.shift)))


def preference_fit(design: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Minimum of the mean of log(1 + exp(-diff @ w)) + ridge / 2 |w|^2, by Newton steps.

    ``diff`` is ``design[better] - design[worse]``, which is never held whole:
    a step sums over blocks of pairs.
    """
    n, width = len(better), design.shape[1]
    w = np.zeros(width)
    for _ in range(rounds):
        pull, bend = np.zeros(width), np.zeros((width, width))
        for at in range(0, n, PAIR_BLOCK):
            diff = design[better[at : at + PAIR_BLOCK]] - design[worse[at : at + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            pull += diff.T @ p
            bend += (diff * (p * (1 - p))[:, None]).T @ diff
        w = w - np.linalg.solve(bend / n + ridge * np.eye(width), ridge * w - pull / n)
    return w


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Model | None:
    """Model from measures and labels; None if only one kind of label is there."""
    if good.all() or not good.any():
        return None
    rng = np.random.default_rng(seed)
    edges = np.quantile(x, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Model(edges, x.mean(0), x.std(0) + 1e-9, np.zeros(1), 0.0)
    design = model.design(x)
    better = rng.choice(np.flatnonzero(good), PAIRS)
    worse = rng.choice(np.flatnonzero(~good), PAIRS)
    model.weight = preference_fit(design, better, worse, 1e-3)
    cut = np.quantile(model.raw(x), (~good).mean())
    model.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return model


def train(docs: DataFrame, key: Column, text: Column, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """Model from labelled rows, and the share of good labels among them.

    ``labels`` holds ``key`` and integer ``quality``. At most ``sample`` rows
    are used; the join broadcasts those alone.
    """
    some = labels.where("quality is not null and key is not null").orderBy(F.xxhash64("key"), "key", "quality").limit(sample)
    base = docs.select(key.alias("key"), text.alias("text"))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(measures(texts.tolist())))

    rows = base.join(F.broadcast(some), "key").select("key", "quality", measured("text").alias("x")).collect()
    if not rows:
        return None, 0.5
    rows.sort(key=lambda r: (r["key"], r["quality"], r["x"]))
    good = np.array([r["quality"] == 1 for r in rows])
    return fit(np.array([r["x"] for r in rows]), good), float(good.mean())


def scored(docs: DataFrame, text: Column, model: Model | None, share: float) -> Column:
    """Score column: 0 to 1, higher where label 1 is likelier; without a model the share of good labels."""
    if model is None:
        return F.lit(share)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return score(text)


def held_out(key: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "quality")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document; null and empty texts are scored like any other."""
    model, share = train(docs, F.col("doc_id"), F.col("text"), training_labels(labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, F.col("text"), model, share).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
