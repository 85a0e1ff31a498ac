import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import impute

SCHEMA = "row int, annee int, age int, sexe string, diagnostic_categorie string"


def rows(n=600, seed=7):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sex = rng.choice(["Homme", "Femme"])
        age = max(0, min(120, int(rng.gauss(40 if sex == "Homme" else 25, 12))))
        out.append((i, 2023 + i % 2, None if rng.random() < 0.3 else age, None if rng.random() < 0.15 else sex,
                    None if rng.random() < 0.3 else rng.choice(["ORL", "TRAUMA", "DIGESTIF"])))
    return out


def by_hand_chain(age, sex, rounds=10, tol=1e-3):
    """Plain dense chain of evidence-tuned ridge lines over the full matrix."""
    x = np.array([age, sex], dtype=float).T
    gaps = np.isnan(x)
    filled = np.where(gaps, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        before = filled.copy()
        for col in np.argsort(gaps.mean(axis=0), kind="stable"):
            seen = ~gaps[:, col]
            f, y = filled[seen, 1 - col], x[seen, col]
            fc, yc = f - f.mean(), y - y.mean()
            alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
            for _ in range(300):
                w = fc @ yc / (fc @ fc + lam / alpha)
                g = alpha * (fc @ fc) / (lam + alpha * (fc @ fc))
                lam = (g + 2e-6) / (w * w + 2e-6)
                alpha = (len(y) - g + 2e-6) / (((yc - w * fc) ** 2).sum() + 2e-6)
                if old is not None and abs(old - w) < 1e-3:
                    break
                old = w
            w = fc @ yc / (fc @ fc + lam / alpha)
            filled[gaps[:, col], col] = y.mean() + w * (filled[gaps[:, col], 1 - col] - f.mean())
        if np.abs(filled - before).sum(axis=1).max() < tol * np.nanmax(np.abs(x)):
            break
    return filled


def test_exact_median_and_mode(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([None, rng.gauss(0, 1), 1.5])) for g in (1, 2, 3) for _ in range(997 + g)]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r.g: r.median for r in impute.exact_median(df, "v", "g").collect()}
    for g in (1, 2, 3):
        assert got[g] == statistics.median(v for k, v in data if k == g and v is not None)
    small = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, None)], "g int, v double")
    assert impute.exact_median(small, "v", "g").collect() == [(1, 2.5)]
    letters = spark.createDataFrame([(1, c) for c in "baab"] + [(1, None)] * 3, "g int, v string")
    assert impute.smallest_mode(letters, "v", "g").collect() == [(1, "a")]


def test_median_mode(spark):
    df = spark.createDataFrame(
        [(0, 1, 1, "Femme", "B"), (1, 1, 2, None, "A"), (2, 1, 3, "Homme", None), (3, 1, 10, None, None),
         (4, 1, None, "Femme", "A"), (5, 2, 7, None, None), (6, 2, None, None, None)], SCHEMA)
    out = {r.row: r for r in impute.impute(df).collect()}
    assert out[4].age_imp == 2.5 and out[0].age_imp == 1.0
    assert out[1].sexe_imp == "Femme" and out[3].diagnostic_categorie_imp == "A"
    assert (out[6].age_imp, out[6].sexe_imp, out[6].diagnostic_categorie_imp) == (7.0, "Homme", "AUTRE")


def test_chain_against_dense_form(spark):
    data = rows()
    out = {r.row: r for r in impute.impute(spark.createDataFrame(data, SCHEMA), "mice").collect()}
    for year in (2023, 2024):
        part = [r for r in data if r[1] == year]
        nan = float("nan")
        age = [nan if r[2] is None else r[2] for r in part]
        sex = [nan if r[3] is None else {"Homme": 0, "Femme": 1}[r[3]] for r in part]
        dense = by_hand_chain(age, sex)
        for r, (a, s) in zip(part, dense):
            assert out[r[0]].age_imp == np.round(a)
            assert out[r[0]].sexe_imp == ("Femme" if np.clip(np.round(s), 0, 1) == 1 else "Homme")


def test_forest_follows_the_group_means(spark):
    data = rows()
    out = impute.random_forest(spark.createDataFrame(data, SCHEMA), rounds=2, trees=10)
    assert out.filter("age_imp is null or sexe_imp is null or diagnostic_categorie_imp is null").count() == 0
    assert out.filter("age is not null and age_imp <> age").count() == 0
    got = out.filter("age is null and sexe = 'Homme' and annee = 2023").agg(F.avg("age_imp")).first()[0]
    known = [r[2] for r in data if r[2] is not None and r[3] == "Homme" and r[1] == 2023]
    assert got == pytest.approx(statistics.mean(known), abs=2.0)


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        impute.impute(spark.createDataFrame([], SCHEMA), "other")


@pytest.mark.parametrize("kind", ["ints", "far", "two", "same", "wide", "ties", "odd"])
def test_median_of_adversarial_values(spark, monkeypatch, kind):
    rng = random.Random(9)
    make = {
        "ints": lambda: float(rng.randint(0, 120)), "far": lambda: rng.choice([-1e300, -1.0, 0.0, 5e-324, 1e300]) * rng.random(),
        "two": lambda: rng.choice([1.0, 2.0]), "same": lambda: 7.5, "wide": lambda: rng.lognormvariate(0, 40),
        "ties": lambda: rng.choice([0.0, 0.0, 0.0, rng.random()]), "odd": lambda: rng.choice([float("inf"), float("-inf"), 1.0, 2.0, 3.0]),
    }[kind]
    rows = [(g, make()) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 500), ("e", 4)) for _ in range(n)] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: statistics.median([v for k, v in rows if k == g and v is not None]) for g in "abcde"}
    for steps, accuracy in ((2000, 10_000), (50, 100)):  # a coarse sketch needs more steps, with the same result
        monkeypatch.setattr(impute, "_STEPS", steps)
        monkeypatch.setattr(impute, "_SKETCH_ACCURACY", accuracy)
        got = {r.g: r.median for r in impute.exact_median(df, "v", "g").collect()}
        assert {k: v for k, v in got.items() if v == v} == {k: v for k, v in want.items() if v == v}
    assert impute.exact_median(df.limit(0), "v", "g").collect() == []


def test_median_gathers_no_group(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    impute.exact_median(df, "v", "g").explain()
    assert "Window" not in capsys.readouterr().out


def test_forest_trees_are_grown_from_counts(spark):
    """Equal rows are counted once: a million equal rows fill as a few thousand do, and no row forest is fitted."""
    from unittest import mock

    from recordloom.operators import impute as module

    pattern = [(a, s) for a in (20, 21, 22) for s in ("Homme",)] + [(a, "Femme") for a in (40, 41, 42)]
    pattern += [(None, "Homme"), (None, "Femme"), (None, None), (21, None), (41, None)]
    shape = "annee int, age int, sexe string, diagnostic_categorie string"
    rows = spark.createDataFrame([(2023, a, s, "ORL") for a, s in pattern], shape).crossJoin(spark.range(20_000)).drop("id")
    with mock.patch.object(module, "RandomForestRegressor", side_effect=AssertionError("rows were trained on")):
        filled = module.random_forest(rows, trees=10).groupBy("age", "sexe").agg(
            {"age_imp": "max", "sexe_imp": "max", "annee": "count"}
        ).collect()
    got = {(r["age"], r["sexe"]): (r["max(age_imp)"], r["max(sexe_imp)"], r["count(annee)"]) for r in filled}
    assert all(n == 20_000 for _, _, n in got.values()) and len(got) == len(pattern)
    assert got[None, "Homme"][0] == 21 and got[None, "Femme"][0] == 41
    assert got[21, None][1] == "Homme" and got[41, None][1] == "Femme"


def test_tree_from_counts_equals_rows_drawn():
    """A tree over summed places cuts where a scan of every cut finds the least squared error."""
    import numpy as np

    from recordloom.operators import trees

    rng = np.random.default_rng(1)
    n = rng.integers(0, 4, 30).astype(float)
    y = rng.normal(size=30)
    got = trees.grow(n, n * y, n * y * y, 1)

    def error(a, b):
        w, v = n[a:b], y[a:b]
        return float((w * (v - (w @ v) / w.sum()) ** 2).sum()) if w.sum() else np.inf

    cut = min(range(1, 30), key=lambda c: error(0, c) + error(c, 30))
    want = np.r_[np.full(cut, (n[:cut] @ y[:cut]) / n[:cut].sum()), np.full(30 - cut, (n[cut:] @ y[cut:]) / n[cut:].sum())]
    assert np.allclose(got, want)
    deep = trees.grow(n, n * y, n * y * y, 30)
    assert np.allclose(deep[n > 0], y[n > 0])
    assert np.isnan(trees.grow(np.zeros(3), np.zeros(3), np.zeros(3), 5)).all()
