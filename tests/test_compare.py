import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from recordloom.functions import tails
from recordloom.operators import compare

YEARS = (2023, 2024)


def counted(spark, table):
    """Rows from {category: (n first year, n second year)}."""
    parts = [(c, y, n) for c, ns in table.items() for y, n in zip(YEARS, ns) if n]
    df = spark.createDataFrame(parts, "c string, annee int, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).select("c", "annee")


def test_published_sex_table(spark):
    df = counted(spark, {"Femme": (382, 773), "Homme": (262, 487)})
    r = compare.chi_square(df, "c", YEARS)
    assert (r["chi2"], r["p_value"], r["dof"]) == (pytest.approx(0.655011249078702), pytest.approx(0.41832670448351306), 1)
    table = {r.c: (r["2023"], r["2024"]) for r in compare.contingency(df, "c", YEARS).collect()}
    assert table == {"Femme": (382, 773), "Homme": (262, 487)}


def test_published_proportions(spark):
    df = counted(spark, {"Trauma": (68, 112), "x": (576, 1148)})
    r = compare.two_proportion_z(df, F.col("c") == "Trauma", YEARS)
    assert r["z"] == pytest.approx(1.1784299603987753)
    assert r["p_value"] == pytest.approx(0.2386252393950703)


def _t_by_simpson(t, v, n=2000):
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    h = t / n
    weights = [1] + [4, 2] * (n // 2 - 1) + [4, 1]
    return 1 - 2 * c * h / 3 * sum(w * (1 + (i * h) ** 2 / v) ** (-(v + 1) / 2) for i, w in enumerate(weights))


def test_tails():
    assert tails.chi_square_upper(5.111372440763744, 3) == pytest.approx(0.16382121558041998, abs=1e-12)
    assert tails.chi_square_upper(4.0, 2) == pytest.approx(0.1353352832366127)
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, abs=1e-12)
    assert tails.t_two_sided(0.5, 1200) == pytest.approx(_t_by_simpson(0.5, 1200), abs=1e-10)
    assert tails.t_two_sided(3.4, 7.5) == pytest.approx(_t_by_simpson(3.4, 7.5), abs=1e-10)
    assert tails.f_upper(4.0, 1, 10) == pytest.approx(tails.t_two_sided(2.0, 10), abs=1e-12)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_larger_table_with_an_empty_cell(spark):
    table = {"a": (10, 20), "b": (30, 5), "c": (0, 7)}
    r = compare.chi_square(counted(spark, table), "c", YEARS)
    n = sum(map(sum, table.values()))
    col = [sum(v[i] for v in table.values()) for i in (0, 1)]
    want = sum((v[i] - sum(v) * col[i] / n) ** 2 / (sum(v) * col[i] / n) for v in table.values() for i in (0, 1))
    assert r["chi2"] == pytest.approx(want) and r["dof"] == 2


def test_means(spark):
    rng = random.Random(5)
    a, b = [rng.gauss(33, 9) for _ in range(301)], [rng.gauss(31, 4) for _ in range(200)]
    df = spark.createDataFrame([(2023, x) for x in a] + [(2024, x) for x in b] + [(2024, None)], "annee int, v double")
    va, vb = statistics.variance(a) / 301, statistics.variance(b) / 200
    want = (statistics.mean(a) - statistics.mean(b)) / (va + vb) ** 0.5
    r = compare.mean_test(df, "v", YEARS)
    assert r["test"] == "Welch" and r["t"] == pytest.approx(want)
    assert r["sd2"] == pytest.approx(statistics.stdev(b))
    za, zb = ([abs(x - statistics.median(s)) for x in s] for s in (a, b))
    grand = statistics.mean(za + zb)
    between = sum(len(z) * (statistics.mean(z) - grand) ** 2 for z in (za, zb))
    within = sum((x - statistics.mean(z)) ** 2 for z in (za, zb) for x in z)
    assert compare.levene(df, "v", YEARS)["w"] == pytest.approx(499 * between / within)
    same = spark.createDataFrame([(y, float(x)) for y in YEARS for x in range(50)], "annee int, v double")
    assert compare.mean_test(same, "v", YEARS)["test"] == "Student"
