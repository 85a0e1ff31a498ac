"""Comparing two years: contingency tables, mean and proportion tests.

Each test is one aggregation that ends in one row of sums; the statistic
follows in closed form and only that row reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.text import round_half_even
from ..session import small_side
from . import impute
from .impute import exact_median

YEAR = "annee"
ALPHA = 0.05
Years = tuple[int, int]


def _over(above: Column, below: Column) -> Column:
    """Quotient; NULL where the divisor is zero."""
    return F.try_divide(above, below)


def _tail(function, *values) -> float | None:
    """A tail probability, or None where the statistic has no value."""
    return None if any(v is None or v != v for v in values) else function(*values)


def contingency(df: DataFrame, category: str, years: Years) -> DataFrame:
    """Category by year; NULL categories dropped, empty cells zero."""
    table = (
        df.filter(F.col(category).isNotNull() & F.col(YEAR).isin(list(years)))
        .groupBy(category).pivot(YEAR, list(years)).count()
    )
    return table.na.fill(0)


def chi_square_sums(df: DataFrame, category: str, years: Years) -> DataFrame:
    """One row: statistic (with continuity correction at one degree) and dof."""
    table = contingency(df, category, years)
    one, two = (F.col(f"`{y}`").cast("double") for y in years)
    row = one + two
    outer = [f(F.struct(one.alias("x"), two.alias("y")), category) for f in (F.min_by, F.max_by)]
    sums = table.agg(
        F.sum(one).alias("c1"), F.sum(two).alias("c2"),
        F.sum(_over(one * one, row)).alias("s1"), F.sum(_over(two * two, row)).alias("s2"),
        F.count(F.lit(1)).alias("rows"), outer[0].alias("p"), outer[1].alias("q"),
    )
    total = F.col("c1") + F.col("c2")
    plain = total * (_over(F.col("s1"), F.col("c1")) + _over(F.col("s2"), F.col("c2")) - 1)
    cross = F.abs(F.col("p.x") * F.col("q.y") - F.col("p.y") * F.col("q.x"))
    row_p, row_q = F.col("p.x") + F.col("p.y"), F.col("q.x") + F.col("q.y")
    moved = F.greatest(cross - total / 2, F.lit(0.0))
    corrected = _over(total * moved * moved, row_p * row_q * F.col("c1") * F.col("c2"))
    # One category: nothing can differ. A year without rows has no statistic.
    alone = F.when((F.col("c1") > 0) & (F.col("c2") > 0), 0.0)
    wide = F.when(plain.isNotNull(), F.greatest(plain, F.lit(0.0)))
    return sums.select(
        F.when(F.col("rows") <= 1, alone).when(F.col("rows") == 2, corrected).otherwise(wide).alias("chi2"),
        F.greatest(F.col("rows") - 1, F.lit(0)).cast("bigint").alias("dof"),
    )


def _two_group_moments(df: DataFrame, value: Column, years: Years) -> DataFrame:
    parts = []
    for i, year in enumerate(years, 1):
        mine = F.when(F.col(YEAR) == year, value.cast("double"))
        parts += [
            F.count(mine).cast("double").alias(f"n{i}"),
            F.avg(mine).alias(f"mean{i}"),
            F.var_samp(mine).alias(f"var{i}"),
        ]
    return df.agg(*parts)


def t_test_sums(df: DataFrame, value: str, years: Years, equal_var: bool) -> DataFrame:
    """One row: t, degrees of freedom, and mean and deviation of both years."""
    m = _two_group_moments(df, F.col(value), years)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    if equal_var:
        dof = n1 + n2 - 2
        pooled = _over((n1 - 1) * v1 + (n2 - 1) * v2, dof)
        error = F.sqrt(pooled * (_over(F.lit(1.0), n1) + _over(F.lit(1.0), n2)))
    else:
        e1, e2 = _over(v1, n1), _over(v2, n2)
        error = F.sqrt(e1 + e2)
        dof = _over((e1 + e2) * (e1 + e2), _over(e1 * e1, n1 - 1) + _over(e2 * e2, n2 - 1))
    return m.select(
        _over(F.col("mean1") - F.col("mean2"), error).alias("t"),
        dof.alias("dof"),
        "mean1", F.sqrt("var1").alias("sd1"), "mean2", F.sqrt("var2").alias("sd2"),
    )


def levene_sums(df: DataFrame, value: str, years: Years) -> DataFrame:
    """One row: median-centred spread statistic and its within-groups dof."""
    known = df.filter(F.col(YEAR).isin(list(years)) & F.col(value).isNotNull()).select(YEAR, value)
    medians = small_side(exact_median(known, value, YEAR, "_median"))
    spread = F.abs(F.col(value).cast("double") - F.col("_median"))
    m = _two_group_moments(known.join(medians, YEAR), spread, years)
    n1, n2, z1, z2 = (F.col(c) for c in ("n1", "n2", "mean1", "mean2"))
    grand = _over(n1 * z1 + n2 * z2, n1 + n2)
    between = n1 * (z1 - grand) * (z1 - grand) + n2 * (z2 - grand) * (z2 - grand)
    within = (n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")
    return m.select(_over((n1 + n2 - 2) * between, within).alias("w"), (n1 + n2 - 2).alias("dof"))


def two_proportion_sums(df: DataFrame, hit: Column, years: Years) -> DataFrame:
    """One row: pooled z and both proportions of the rows of ``hit``."""
    parts = []
    for i, year in enumerate(years, 1):
        mine = F.col(YEAR) == year
        parts.append(F.sum(F.when(mine, 1.0).otherwise(0.0)).alias(f"n{i}"))
        parts.append(F.sum(F.when(mine & hit, 1.0).otherwise(0.0)).alias(f"k{i}"))
    p1, p2 = _over(F.col("k1"), F.col("n1")), _over(F.col("k2"), F.col("n2"))
    pooled = _over(F.col("k1") + F.col("k2"), F.col("n1") + F.col("n2"))
    error = F.sqrt(pooled * (1 - pooled) * (_over(F.lit(1.0), F.col("n1")) + _over(F.lit(1.0), F.col("n2"))))
    return df.agg(*parts).select(_over(p1 - p2, error).alias("z"), p1.alias("prop1"), p2.alias("prop2"))


def chi_square(df: DataFrame, category: str, years: Years) -> dict:
    row = chi_square_sums(df, category, years).first()
    p = _tail(tails.chi_square_upper, row["chi2"], row["dof"])
    return {"chi2": row["chi2"], "dof": row["dof"], "p_value": p}


def t_test(df: DataFrame, value: str, years: Years, equal_var: bool) -> dict:
    row = t_test_sums(df, value, years, equal_var).first().asDict()
    return {**row, "p_value": _tail(tails.t_two_sided, row["t"], row["dof"])}


def levene(df: DataFrame, value: str, years: Years) -> dict:
    row = levene_sums(df, value, years).first()
    return {"w": row["w"], "dof": row["dof"], "p_value": _tail(tails.f_upper, row["w"], 1, row["dof"])}


def two_proportion_z(df: DataFrame, hit: Column, years: Years) -> dict:
    row = two_proportion_sums(df, hit, years).first().asDict()
    return {**row, "p_value": _tail(tails.normal_two_sided, row["z"])}


def mean_test(df: DataFrame, value: str, years: Years) -> dict:
    """Student's test if the spreads do not differ, Welch's otherwise.

    Spreads that cannot be compared (a year without rows, or no spread at all)
    lead to Welch's test. A test without a value has NULL for statistic and p.
    """
    p = levene(df, value, years)["p_value"]
    equal_var = p is not None and p > ALPHA
    name = "Student" if equal_var else "Welch"
    return {"test": name, **t_test(df, value, years, equal_var)}


def comparative_statistics(df: DataFrame, years: Years) -> dict[str, dict]:
    """Sex, age, category and trauma share of two years, with their tables."""
    trauma = F.col("categorie_diagnostique_large") == "Trauma"
    return {
        "sexe": {"table": contingency(df, "sexe_imp", years), **chi_square(df, "sexe_imp", years)},
        "age": mean_test(df, "age_imp", years),
        "diagnostic": {
            "table": contingency(df, "categorie_diagnostique_large", years),
            **chi_square(df, "categorie_diagnostique_large", years),
        },
        "trauma_proportion": two_proportion_z(df, trauma, years),
    }


# Columns of the result table, and the names of variables and tests below.
SUMMARY_SCHEMA = "Variable string, Test string, Statistique double, p_value double"


def test_summary(df: DataFrame, years: Years) -> DataFrame:
    """The four tests as a table."""
    r = comparative_statistics(df, years)
    rows = [
        ("Sexe", "Chi2 de Pearson", r["sexe"]["chi2"], r["sexe"]["p_value"]),
        ("Age", r["age"]["test"], r["age"]["t"], r["age"]["p_value"]),
        ("Categorie diagnostique", "Chi2 de Pearson", r["diagnostic"]["chi2"], r["diagnostic"]["p_value"]),
        ("Proportion Trauma", "Test de proportion (z)", r["trauma_proportion"]["z"], r["trauma_proportion"]["p_value"]),
    ]
    return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)


def dedup_impact(before: DataFrame, after: DataFrame, years: Years) -> DataFrame:
    """Sex and age tests before and after deduplication, side by side."""
    rows = []
    for stage, df in (("avant", before), ("apres", after)):
        sex, age = chi_square(df, "sexe_imp", years), mean_test(df, "age_imp", years)
        rows.append((stage, "Sexe", "Chi2 de Pearson", sex["chi2"], sex["p_value"]))
        rows.append((stage, "Age", age["test"], age["t"], age["p_value"]))
    return before.sparkSession.createDataFrame(rows, f"Etape string, {SUMMARY_SCHEMA}")


def sensitivity(df: DataFrame, years: Years, methods: tuple[str, ...] = tuple(impute.METHODS)) -> DataFrame:
    """Mean imputed age of both years and Welch's p-value, per method."""
    rows = []
    for method in methods:
        result = t_test(impute.impute(df, method), "age_imp", years, equal_var=False)
        rows.append((impute.METHODS[method], result["mean1"], result["mean2"], result["p_value"]))
    table = df.sparkSession.createDataFrame(rows, "method string, mean_1 double, mean_2 double, p_value double")
    return table.withColumns({c: round_half_even(F.col(c), 1) for c in ("mean_1", "mean_2")})
