"""Data quality of the clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, typed
from ..functions.text import round_half_even
from ..operators.counts import percent

MEASURES = ("completude", "exactitude", "concordance", "unicite")


def quality_report(df: DataFrame) -> DataFrame:
    """Completeness, accuracy, concordance and uniqueness per variable.

    One aggregation feeds all rows. The last row is the plain mean of the
    rounded values above it.
    """
    age, sex, category = F.col("age"), F.col("sexe"), F.col("diagnostic_categorie")
    plausible = (typed.AGE_MIN, typed.AGE_MAX)
    trauma = F.coalesce(category == "TRAUMA", F.lit(False))
    constant, missing = F.lit(100.0), F.lit(None).cast("double")
    measures: dict[str, list[Column]] = {
        "Age": [
            percent(age.isNotNull()),
            percent(age.between(*plausible), age.isNotNull()),
            percent(F.col("age_imp").between(*plausible)),
        ],
        "Sexe": [
            percent(sex.isNotNull()),
            percent(sex.isin(labels.MALE, labels.FEMALE), sex.isNotNull()),
            percent(F.col("sexe_concordant")),
        ],
        "Diagnostic principal": [
            percent(category.isNotNull()),
            percent(category.isin(*labels.PLAUSIBLE_DIAGNOSES), category.isNotNull()),
            missing,
        ],
        "Type de trauma": [
            F.coalesce(percent(F.col("trauma_type").isNotNull(), trauma), F.lit(0.0)),
            missing,
            missing,
        ],
        "Date de consultation": [percent(F.col("date_entree").isNotNull()), constant, constant],
    }
    flat = {
        f"m{i}_{name}": round_half_even(value, 1)
        for i, row in enumerate(measures.values())
        for name, value in zip(MEASURES, [*row, constant])
    }
    one = df.agg(*[value.alias(name) for name, value in flat.items()])

    def mean(name: str) -> Column:
        values = F.filter(F.array(*[F.col(f"m{i}_{name}") for i in range(len(measures))]), F.isnotnull)
        return round_half_even(F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values), 1)

    rows = [
        F.struct(F.lit(variable).alias("Variable"), *[F.col(f"m{i}_{name}").alias(name) for name in MEASURES])
        for i, variable in enumerate(measures)
    ]
    rows.append(F.struct(F.lit("Moyenne").alias("Variable"), *[mean(name).alias(name) for name in MEASURES]))
    return one.select(F.inline(F.array(*rows)))
