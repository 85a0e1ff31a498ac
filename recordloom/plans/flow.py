"""Descriptive reports over the clean table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..operators import counts


def enrich(df: DataFrame) -> DataFrame:
    """Hour, weekday, date and age band of each visit."""
    entry = F.col("date_entree")
    return df.withColumns(
        {
            "Heure_entree": F.hour(entry),
            "Jour_semaine": typed.weekday_name(entry),
            "Date": F.to_date(entry),
            "tranche_age": typed.age_band(F.col("age")),
        }
    )


def patient_flow(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "patients": counts.distinct_count(df, "dossier", "n_patients"),
        "par_annee": counts.counts_by_key(df, "annee"),
        "par_sexe": counts.value_counts(df, "sexe", keep_null=True),
        "par_tranche_age": counts.band_counts(df),
        "par_heure": counts.two_key_counts(df, "Heure_entree", "annee"),
        "par_jour": counts.counts_by_key(df, "Date"),
    }


def diagnoses(df: DataFrame) -> dict[str, DataFrame]:
    if "diagnostic_categorie" not in df.columns:
        return {}
    return {"top_categories": counts.top_values(df, "diagnostic_categorie")}


def trauma(df: DataFrame) -> dict[str, DataFrame]:
    cases = df.filter(F.col("categorie_diagnostique_large") == "Trauma")
    out = {"cas_trauma": cases.agg(F.count(F.lit(1)).alias("n"))}
    if "trauma_type" in df.columns:
        out["causes_trauma"] = counts.shares(cases, "trauma_type")
    return out


def services(df: DataFrame) -> dict[str, DataFrame]:
    return {"services": counts.value_counts(df, "service_principal")}


def outcomes(df: DataFrame) -> dict[str, DataFrame]:
    columns = ("typologie_cas", "evolution_immediate", "duree_hospitalisation")
    return {c: counts.value_counts(df, c, keep_null=True) for c in columns}


def full_report(df: DataFrame) -> dict[str, DataFrame]:
    """All reports in their fixed order; ``df`` is the output of ``enrich``."""
    return {**patient_flow(df), **diagnoses(df), **trauma(df), **services(df), **outcomes(df)}
