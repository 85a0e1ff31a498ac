"""The whole cleaning run: answers to clean visits, with its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_even
from ..operators import dedup, eav
from ..operators.impute import impute
from ..session import staged
from ..sources.tables import CLEAN_COLUMNS


@dataclass
class Cleaned:
    """Visits after each stage and the volume report."""

    visits: DataFrame
    imputed: DataFrame
    clean: DataFrame
    volumetry: DataFrame

    @property
    def export(self) -> DataFrame:
        """The published columns of the clean table."""
        return self.clean.select(*CLEAN_COLUMNS)


def volumetry(visits: DataFrame, report: DataFrame) -> DataFrame:
    """Rows in, visits before and after, retention and duplicates per year."""
    volumes = visits.groupBy("annee").agg(
        F.sum("n_lignes").alias("n_lignes_eav_brutes"),
        F.count(F.lit(1)).alias("n_patients_avant_dedup"),
    )
    before = F.col("n_patients_avant_dedup")
    return volumes.join(report, "annee").select(
        "annee",
        "n_lignes_eav_brutes",
        "n_patients_avant_dedup",
        F.col("n_apres").alias("n_patients_apres_dedup"),
        round_half_even(100 * F.col("n_apres") / before, 1).alias("taux_retention_patients_pct"),
        "n_avant",
        "n_apres",
        "n_doublons_supprimes",
        "taux_doublons_pct",
        "n_paires_evaluees",
    )


def clean(
    raw: DataFrame,
    method: str = "median_mode",
    threshold: float = dedup.THRESHOLD,
    repair: bool = True,
    iso_day_first: bool = False,
    list_columns: dict[str, str] | None = None,
) -> Cleaned:
    """Raw answers of any number of years to clean visits, in one run.

    The answers are read once: the normalised visits are written to the shared
    folder and every later stage works on them.
    """
    answers = eav.clean_eav(raw, repair)
    visits = staged(
        eav.normalised_visits(answers, list_columns or eav.LIST_COLUMNS, iso_day_first, repair), "visits"
    )
    imputed = impute(visits, method)
    kept, report = dedup.deduplicate(imputed, threshold)
    return Cleaned(visits, imputed, kept, volumetry(visits, report))
