"""Filling gaps in age, sex and category, separately for each year."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels
from ..functions.text import round_half_even
from ..session import few_rows_or_none, settled, small_side, staged
from . import trees as growing

YEAR = "annee"
SEED = 42
METHODS = {
    "median_mode": "Median/Mode",
    "mice": "MICE",
    "random_forest": "Random Forest",
}
# Quantiles that a selection step looks at, and the rank accuracy of their sketch.
_STEPS, _SKETCH_ACCURACY = 2_000, 10_000


def _grid(value: Column) -> Column:
    steps = F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)])
    return F.percentile_approx(value, steps, _SKETCH_ACCURACY)


def _around(grid: Column, place: Column) -> tuple[Column, Column]:
    """Quantiles one step and the sketch's error below and above a place between 0 and 1."""
    low = F.greatest(F.floor(place * _STEPS) - 2, F.lit(0)).cast("int")
    high = F.least(F.ceil(place * _STEPS) + 2, F.lit(_STEPS)).cast("int")
    return F.get(grid, low), F.get(grid, high)


def value_at_ranks(known: DataFrame, by: str, ranks: Column) -> DataFrame:
    """Values of ``_v`` at given ranks (from 1) of each group: ``by``, ``_rank``, ``_value``.

    ``ranks`` is an array made of ``_n``, the rows of the group. A sketch puts
    a bracket around a rank. Each step counts what lies below the bracket, on
    its two ends and inside, and either finds the rank on an end, or goes on
    with a bracket that is strictly smaller or lies beyond this one. Every step
    is one aggregation with state of fixed size, whatever the values are.
    """
    groups = known.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), _grid(F.col("_v")).alias("_grid"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    ranked = groups.withColumn("_rank", F.explode(ranks))
    low, high = _around(F.col("_grid"), (F.col("_rank") - 0.5) / F.col("_n"))
    limits = [by, "_rank", "_min", "_max"]
    open_ = settled(ranked.select(*limits, low.alias("_lo"), high.alias("_hi")), "brackets")
    found = []
    while not open_.isEmpty():
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")

        def number(where: Column) -> Column:
            return F.count(F.when(where, 1))

        counted = known.join(small_side(open_), by).groupBy(*limits, "_lo", "_hi").agg(
            number(v < lo).alias("_below"), number(v == lo).alias("_on_lo"), number((v == hi) & (hi > lo)).alias("_on_hi"),
            number((v > lo) & (v < hi)).alias("_inside"), _grid(F.when((v > lo) & (v < hi), v)).alias("_grid"),
            F.max(F.when(v < lo, v)).alias("_under"), F.min(F.when(v > hi, v)).alias("_over"),
        )
        rank = F.col("_rank") - F.col("_below")
        after_lo, before_hi = rank - F.col("_on_lo"), rank - F.col("_on_lo") - F.col("_inside")
        value = F.when((rank > 0) & (after_lo <= 0), lo).when((before_hi > 0) & (before_hi <= F.col("_on_hi")), hi)
        low, high = _around(F.col("_grid"), (after_lo - 0.5) / F.col("_inside"))
        next_lo = F.when(rank <= 0, F.col("_min")).when(before_hi > 0, F.col("_over")).otherwise(low)
        next_hi = F.when(rank <= 0, F.col("_under")).when(before_hi > 0, F.col("_max")).otherwise(high)
        step = settled(counted.select(*limits, value.alias("_value"), next_lo.alias("_lo"), next_hi.alias("_hi")), "ranks")
        found.append(step.filter("_value is not null").select(by, "_rank", "_value"))
        open_ = step.filter("_value is null").drop("_value")
    if not found:
        return open_.select(by, "_rank", F.col("_lo").alias("_value"))
    return reduce(DataFrame.unionByName, found)


def exact_median(df: DataFrame, value: str, by: str, name: str = "median") -> DataFrame:
    """Exact median per group, NULLs ignored; mean of the middle two."""
    known = df.select(by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    half = (F.col("_n") + 1) / 2
    middle = value_at_ranks(known, by, F.array_distinct(F.array(F.floor(half), F.ceil(half))))
    return middle.groupBy(by).agg(F.avg("_value").alias(name))


def smallest_mode(df: DataFrame, value: str, by: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(name))


def _mode_filled(df: DataFrame, column: str, default: str) -> DataFrame:
    modes = small_side(smallest_mode(df, column, YEAR, "_mode"))
    filled = F.coalesce(column, "_mode", F.lit(default))
    return df.join(modes, YEAR, "left").withColumn(f"{column}_imp", filled).drop("_mode")


def median_mode(df: DataFrame) -> DataFrame:
    medians = small_side(exact_median(df, "age", YEAR, "_median"))
    aged = df.join(medians, YEAR, "left").withColumn(
        "age_imp", F.coalesce(F.col("age").cast("double"), F.col("_median"))
    )
    sexed = _mode_filled(aged.drop("_median"), "sexe", labels.MALE)
    return _mode_filled(sexed, "diagnostic_categorie", labels.OTHER)


def sex_code(sex: Column) -> Column:
    return F.when(sex == labels.MALE, F.lit(0.0)).when(sex == labels.FEMALE, F.lit(1.0))


def sex_from_code(code: Column) -> Column:
    # greatest and least skip NULL, so an unknown code has to be kept apart.
    nearest = F.when(code.isNotNull(), F.greatest(F.least(round_half_even(code), F.lit(1.0)), F.lit(0.0)))
    return F.when(nearest == 0, F.lit(labels.MALE)).when(nearest == 1, F.lit(labels.FEMALE))


def _ridge_line(n: float, sx: float, sy: float, sxx: float, sxy: float, syy: float) -> tuple[float, float]:
    """Intercept and slope of a Bayesian ridge line, from sums alone.

    Noise and weight precision are re-estimated from the evidence until the
    slope settles; all it needs is the centred second moments.
    """
    mean_x, mean_y = sx / n, sy / n
    vxx, vxy, vyy = sxx - n * mean_x**2, sxy - n * mean_x * mean_y, syy - n * mean_y**2
    vxx, vyy = max(vxx, 0.0), max(vyy, 0.0)
    prior, before, slope = 1e-6, None, 0.0
    noise, weight = 1.0 / (vyy / n + 2.220446049250313e-16), 1.0
    for _ in range(300):
        slope = vxy / (vxx + weight / noise)
        residual = max(vyy - 2 * slope * vxy + slope**2 * vxx, 0.0)
        effective = noise * vxx / (weight + noise * vxx)
        weight = (effective + 2 * prior) / (slope**2 + 2 * prior)
        noise = (n - effective + 2 * prior) / (residual + 2 * prior)
        if before is not None and abs(before - slope) < 1e-3:
            break
        before = slope
    slope = vxy / (vxx + weight / noise)
    return mean_y - slope * mean_x, slope


@dataclass
class _Fill:
    """How one column is filled: a line over the other, or a constant if both miss."""

    intercept: float
    slope: float = 0.0
    both: float = 0.0

    def at(self, x: float) -> float:
        return self.intercept + self.slope * x


def _known_moments(df: DataFrame) -> DataFrame:
    """Sums over the rows with both, only age, or only sex known; one row a year."""
    age, sex = F.col("age").cast("double"), sex_code(F.col("sexe"))
    has = {"c": age.isNotNull() & sex.isNotNull(), "a": age.isNotNull() & sex.isNull(),
           "s": age.isNull() & sex.isNotNull()}
    zero = F.lit(0.0)
    sums = []
    for part, rows in has.items():
        for name, term in (("n", F.lit(1.0)), ("a", age), ("s", sex), ("aa", age * age), ("ss", sex * sex), ("as", age * sex)):
            sums.append(F.sum(F.when(rows, F.coalesce(term, zero)).otherwise(zero)).alias(f"{part}_{name}"))
    edges = [
        f(F.when(has[part], column)).alias(f"{part}_{label}")
        for part, column in (("a", age), ("s", sex))
        for label, f in (("min", F.min), ("max", F.max))
    ]
    both = F.sum(F.when(age.isNull() & sex.isNull(), 1.0).otherwise(0.0)).alias("b_n")
    largest = F.greatest(F.max(F.abs(age)), F.max(F.abs(sex))).alias("largest")
    return df.groupBy(YEAR).agg(*sums, *edges, both, largest)


def _chained_fills(m: dict, rounds: int, tolerance: float = 1e-3) -> tuple[_Fill, _Fill] | None:
    """Fit the chain for one year from its moments; no data pass per round.

    A filled value is a line over the other column, so the sums a refit needs
    follow from the moments and the current lines.
    """
    n_age, n_sex = m["c_n"] + m["a_n"], m["c_n"] + m["s_n"]
    if n_age == 0 or n_sex == 0:
        return None
    age = _Fill((m["c_a"] + m["a_a"]) / n_age)
    sex = _Fill((m["c_s"] + m["s_s"]) / n_sex)
    age.both, sex.both = age.intercept, sex.intercept

    def refit_age() -> _Fill:
        i, k, n, a, aa = sex.intercept, sex.slope, m["a_n"], m["a_a"], m["a_aa"]
        line = _Fill(*_ridge_line(
            n_age, m["c_s"] + i * n + k * a, m["c_a"] + a,
            m["c_ss"] + i * i * n + 2 * i * k * a + k * k * aa,
            m["c_as"] + i * a + k * aa, m["c_aa"] + aa))
        line.both = line.at(sex.both)
        return line

    def refit_sex() -> _Fill:
        i, k, n, s, ss = age.intercept, age.slope, m["s_n"], m["s_s"], m["s_ss"]
        line = _Fill(*_ridge_line(
            n_sex, m["c_a"] + i * n + k * s, m["c_s"] + s,
            m["c_aa"] + i * i * n + 2 * i * k * s + k * k * ss,
            m["c_as"] + i * s + k * ss, m["c_ss"] + ss))
        line.both = line.at(age.both)
        return line

    age_gaps, sex_gaps = m["s_n"] + m["b_n"], m["a_n"] + m["b_n"]
    for _ in range(rounds):
        old_age, old_sex = age, sex
        # The column with fewer gaps is refitted first.
        for column in ("age", "sex") if age_gaps <= sex_gaps else ("sex", "age"):
            if column == "age":
                age = refit_age()
            else:
                sex = refit_sex()
        change = 0.0
        if m["s_n"]:
            change = max(abs(age.at(x) - old_age.at(x)) for x in (m["s_min"], m["s_max"]))
        if m["a_n"]:
            change = max(change, *(abs(sex.at(x) - old_sex.at(x)) for x in (m["a_min"], m["a_max"])))
        if m["b_n"]:
            change = max(change, abs(age.both - old_age.both) + abs(sex.both - old_sex.both))
        if change < tolerance * m["largest"]:
            break
    return age, sex


def _rounded(df: DataFrame, age: Column, sex: Column) -> DataFrame:
    filled = df.withColumns(
        {"age_imp": round_half_even(age), "sexe_imp": F.coalesce(sex_from_code(sex), F.col("sexe"))}
    )
    return _mode_filled(filled, "diagnostic_categorie", labels.OTHER)


def mice(df: DataFrame, rounds: int = 10) -> DataFrame:
    """Chained regressions of age and sex on each other, one completion.

    One aggregate gives the moments of every year, one row each; a year is
    fitted from its row wherever that row is, so any number of years will do.
    A year without a known age or without a known sex has no fit: its gaps stay
    NULL in ``age_imp``, and an unknown sex stays unknown.
    """
    names = ["_ai", "_ak", "_ab", "_si", "_sk", "_sb"]

    def fit(batches):
        for batch in batches:
            fills = []
            for row in batch.to_dict("records"):
                fitted = _chained_fills(row, rounds)
                if fitted:
                    age, sex = fitted
                    fills.append((row[YEAR], age.intercept, age.slope, age.both, sex.intercept, sex.slope, sex.both))
            yield pd.DataFrame(fills, columns=[YEAR, *names])

    moments = staged(_known_moments(df), "moments")
    lines = small_side(moments.mapInPandas(fit, f"{YEAR} int, " + ", ".join(f"{n} double" for n in names)))
    age, sex = F.col("age").cast("double"), sex_code(F.col("sexe"))
    filled_age = F.coalesce(age, F.col("_ai") + F.col("_ak") * sex, F.col("_ab"))
    filled_sex = F.coalesce(sex, F.col("_si") + F.col("_sk") * age, F.col("_sb"))
    out = _rounded(df.join(lines, YEAR, "left"), filled_age, filled_sex)
    return out.drop("_ai", "_ak", "_ab", "_si", "_sk", "_sb")


def _forest_year(
    rows: DataFrame, rounds: int, trees: int, depth: int, bins: int | None, tolerance: float = 1e-3
) -> DataFrame:
    """Chained forests for one year.

    A filled value depends only on what is known in the row, so the state is
    one row per distinct (age, sex) pair. Equal rows train a tree alike, so the
    rows are counted once and every tree is grown from the counts, which a
    bootstrap draws by. With more pairs than may be broadcast, or with a limit
    on the bins, forests are trained on the rows themselves.
    """
    cells = settled(rows.groupBy("_age", "_sex").agg(F.count(F.lit(1)).alias("_n")), "forest-cells")
    counted = bins is None and few_rows_or_none(cells) is not None
    means = cells.agg(
        (F.sum(F.col("_age") * F.col("_n")) / F.sum(F.when(F.col("_age").isNotNull(), F.col("_n")))).alias("age"),
        (F.sum(F.col("_sex") * F.col("_n")) / F.sum(F.when(F.col("_sex").isNotNull(), F.col("_n")))).alias("sex"),
        F.coalesce(F.sum(F.when(F.col("_age").isNull(), F.col("_n"))), F.lit(0)).alias("age_gaps"),
        F.coalesce(F.sum(F.when(F.col("_sex").isNull(), F.col("_n"))), F.lit(0)).alias("sex_gaps"),
        F.greatest(F.max(F.abs("_age")), F.max(F.abs("_sex"))).alias("largest"),
    ).first()
    state = settled(
        cells.select(
            "_age", "_sex",
            F.coalesce("_age", F.lit(means["age"]).cast("double")).alias("age_now"),
            F.coalesce("_sex", F.lit(means["sex"]).cast("double")).alias("sex_now"),
            "_n",
        ),
        "forest",
    )
    if means["age"] is None or means["sex"] is None or means["age_gaps"] + means["sex_gaps"] == 0:
        return state

    def updated(scored: DataFrame, target: str) -> DataFrame:
        return scored.select(
            "_age", "_sex",
            *[
                (F.coalesce(f"_{c}", "prediction") if c == target else F.col(f"{c}_now")).alias(f"{c}_now")
                for c in ("age", "sex")
            ],
            "_n",
        )

    def tree_by_tree(cells: pd.DataFrame) -> pd.DataFrame:
        return growing.fitted(cells, depth, SEED)

    def refit_counted(state: DataFrame, target: str, feature: str) -> DataFrame:
        """Every tree is a group of its own; the state is few rows."""
        columns = ["_age", "_sex", "_n", F.col(f"{feature}_now").alias("x"), F.col(f"_{target}").alias("label")]
        copies = state.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("tree", *columns)
        grown = copies.groupBy("tree").applyInPandas(tree_by_tree, "_age double, _sex double, prediction double")
        known = F.when(~F.isnan("prediction"), F.col("prediction"))
        mean = grown.groupBy(F.col("_age").alias("a"), F.col("_sex").alias("s")).agg(F.avg(known).alias("prediction"))
        same = F.col("_age").eqNullSafe(F.col("a")) & F.col("_sex").eqNullSafe(F.col("s"))
        return updated(state.join(mean, same), target)

    def refit_rows(state: DataFrame, target: str, feature: str) -> DataFrame:
        same = F.col("r._age").eqNullSafe(F.col("c._age")) & F.col("r._sex").eqNullSafe(F.col("c._sex"))
        train = (
            rows.alias("r").join(small_side(state).alias("c"), same)
            .filter(F.col(f"r._{target}").isNotNull())
            .select(F.col(f"r._{target}").alias("label"), F.col(f"c.{feature}_now").alias("x"))
        )
        assembler = VectorAssembler(inputCols=["x"], outputCol="features")
        forest = RandomForestRegressor(numTrees=trees, seed=SEED, maxDepth=depth, maxBins=bins, maxMemoryInMB=512)
        model = forest.fit(assembler.transform(train))
        scored = model.transform(assembler.transform(state.withColumn("x", F.col(f"{feature}_now"))))
        return updated(scored, target)

    refit = refit_counted if counted else refit_rows
    if bins is None and not counted:
        # Enough bins to part all values a feature can take.
        kinds = cells.agg(F.count_distinct("_age").alias("age"), F.count_distinct("_sex").alias("sex")).first()
        bins = max(32, 2 * max(kinds) + 2)
    order = [("age", "sex"), ("sex", "age")]
    if means["age_gaps"] > means["sex_gaps"]:
        order.reverse()
    for _ in range(rounds):
        before = state
        for target, feature in order:
            if means[f"{target}_gaps"]:
                state = settled(refit(state, target, feature), "forest")
        same = F.col("a._age").eqNullSafe(F.col("b._age")) & F.col("a._sex").eqNullSafe(F.col("b._sex"))
        change = before.alias("a").join(state.alias("b"), same).agg(
            F.max(F.abs(F.col("a.age_now") - F.col("b.age_now")) + F.abs(F.col("a.sex_now") - F.col("b.sex_now")))
        ).first()[0]
        if change < tolerance * means["largest"]:
            break
    return state


def random_forest(df: DataFrame, rounds: int = 5, trees: int = 50, depth: int = 12, bins: int | None = None) -> DataFrame:
    """Chained random forests of age and sex on each other, year by year.

    ``depth`` levels can part 2 ** depth values of the one feature; ``bins``
    follow from the number of distinct values unless given. Rows are counted
    once, so their number decides neither the fits nor the rounds. Years are read from
    a written list one by one; their number is not limited, but each is a fit.
    """
    known = df.select(YEAR, F.col("age").cast("double").alias("_age"), sex_code(F.col("sexe")).alias("_sex"))
    known = staged(known, "forest-input")
    filled = None
    years = staged(known.select(YEAR).distinct(), "forest-years")
    for row in years.orderBy(YEAR).toLocalIterator():
        one = _forest_year(known.filter(F.col(YEAR).eqNullSafe(F.lit(row[YEAR]))), rounds, trees, depth, bins)
        one = one.drop("_n").withColumn(YEAR, F.lit(row[YEAR]))
        filled = one if filled is None else filled.unionByName(one)
    if filled is None:
        raise ValueError("no rows to fit a forest on")
    filled = small_side(filled).withColumnRenamed(YEAR, "_year")
    age, sex = F.col("age").cast("double"), sex_code(F.col("sexe"))
    matched = (
        F.col(YEAR).eqNullSafe(F.col("_year"))
        & age.eqNullSafe(F.col("_age"))
        & sex.eqNullSafe(F.col("_sex"))
    )
    out = _rounded(df.join(filled, matched, "left"), F.col("age_now"), F.col("sex_now"))
    return out.drop("_year", "_age", "_sex", "age_now", "sex_now")


def impute(df: DataFrame, method: str = "median_mode") -> DataFrame:
    """Add age_imp, sexe_imp and diagnostic_categorie_imp."""
    if method == "median_mode":
        return median_mode(df)
    if method == "mice":
        return mice(df)
    if method == "random_forest":
        return random_forest(df)
    raise ValueError(f"unknown imputation method: {method}")
