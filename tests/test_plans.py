import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.functions.text import round_half_even
from recordloom.operators import compare, eav
from recordloom.plans import cleaning, flow, quality
from recordloom.sources import tables


def raw(spark):
    """Two years of small visits; each year ends with a repeat of its first visit."""
    rows = []
    for year in (2023, 2024):
        people = [
            ("Awa", "Diop", "30", "Femme", "Affections ORL", "U1"),
            ("Modou", "Fall", "41 ans", "Homme", "Accident moto", "E2"),
            ("Fatou", "Sarr", None, "Femme", None, "P3"),
            ("Ibra", "Ba", "7", None, "Accidents domestiques", "U4"),
            ("Awa", "Diop", "30", "Femme", "Affections digestives", "U5"),
        ]
        n = 0
        for i, (first, last, age, sex, diagnosis, code) in enumerate(people):
            answers = [
                ("Identifiant : Prénom", first), ("Identifiant : Nom", last), ("Identifiant : Age", age),
                ("Identifiant : Identifiant patient", code),
                (f"Sexe : {sex}", "on" if sex else None), (f"Diagnostic retenu ou évoqué : {diagnosis}", "on" if diagnosis else None),
                ("Service : Urologie", "on"), ("Typologie du cas : cas simple", "on" if i % 2 else None),
            ]
            for attribute, answer in answers:
                rows.append((n, "t", attribute, "p", f"{year}-{i}", f"0{i // 4 + 1}/09/{year} 08:15", answer, year))
                n += 1
    schema = tables.RAW_SCHEMA + ", annee int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def cleaned(spark):
    return cleaning.clean(raw(spark))


def test_cleaning_run(cleaned):
    out = {r.annee: r for r in cleaned.volumetry.collect()}
    assert set(out) == {2023, 2024}
    r = out[2023]
    assert (r.n_lignes_eav_brutes, r.n_patients_avant_dedup, r.n_patients_apres_dedup) == (40, 5, 4)
    assert (r.taux_retention_patients_pct, r.taux_doublons_pct, r.n_paires_evaluees) == (80.0, 20.0, 1)
    rows = {r.dossier: r for r in cleaned.export.collect()}
    assert "2023-4" not in rows and len(rows) == 8
    assert rows["2023-2"].age is None and rows["2023-2"].age_imp == 30.0
    assert rows["2023-3"].sexe_imp == "Femme"
    assert rows["2023-0"].date_entree == dt.datetime(2023, 9, 1, 8, 15)
    assert rows["2023-1"].categorie_diagnostique_large == "Trauma"
    assert cleaned.export.columns == list(tables.CLEAN_COLUMNS)


def test_quality(spark, cleaned):
    out = {r.Variable: tuple(r)[1:] for r in quality.quality_report(cleaned.clean).collect()}
    assert out["Age"] == (75.0, 100.0, 100.0, 100.0)
    assert out["Sexe"] == (75.0, 100.0, 75.0, 100.0)
    assert out["Diagnostic principal"] == (75.0, 100.0, None, 100.0)
    assert out["Type de trauma"] == (100.0, None, None, 100.0)
    assert out["Moyenne"] == (85.0, 100.0, 91.7, 100.0)


def test_mean_row_of_published_values(spark):
    values = spark.createDataFrame([(70.2,), (88.3,), (64.5,), (100.0,), (100.0,)], "x double")
    assert values.agg(round_half_even(F.avg("x"), 1)).first()[0] == 84.6


def test_flow_reports(cleaned):
    report = flow.full_report(flow.enrich(cleaned.export))
    assert list(report) == [
        "patients", "par_annee", "par_sexe", "par_tranche_age", "par_heure", "par_jour", "top_categories",
        "cas_trauma", "causes_trauma", "services", "typologie_cas", "evolution_immediate", "duree_hospitalisation"]
    got = {k: [tuple(r) for r in v.collect()] for k, v in report.items()}
    assert got["patients"] == [(8,)]
    assert got["par_annee"] == [(2023, 4), (2024, 4)]
    assert got["par_sexe"] == [("Femme", 4), ("Homme", 2), (None, 2)]
    assert [r[2] for r in got["par_tranche_age"]] == [0, 2, 0, 2, 2, 0, 0]
    assert got["par_heure"] == [(8, 2023, 4), (8, 2024, 4)]
    assert got["top_categories"] == [("TRAUMA", 4), ("ORL", 2)]
    assert got["causes_trauma"] == [("Accident domestique", 2, 50.0), ("Accident moto", 2, 50.0)]
    assert got["typologie_cas"] == [(None, 4), ("cas simple", 4)] or got["typologie_cas"] == [("cas simple", 4), (None, 4)]
    assert flow.diagnoses(cleaned.export.drop("diagnostic_categorie")) == {}


def test_comparisons_over_the_run(cleaned):
    summary = compare.test_summary(cleaned.clean, (2023, 2024)).collect()
    assert [r.Variable for r in summary] == ["Sexe", "Age", "Categorie diagnostique", "Proportion Trauma"]
    assert all(r.p_value == pytest.approx(1.0) for r in summary)
    impact = compare.dedup_impact(cleaned.imputed, cleaned.clean, (2023, 2024)).collect()
    assert [r.Etape for r in impact] == ["avant", "avant", "apres", "apres"]
    table = compare.sensitivity(cleaned.visits, (2023, 2024), ("median_mode", "mice")).collect()
    assert [r.method for r in table] == ["Median/Mode", "MICE"]


def test_csv_round_trip(spark, cleaned, tmp_path):
    tables.write_csv(cleaned.export, str(tmp_path / "clean"))
    back = tables.read_clean(spark, str(tmp_path / "clean"))
    key = lambda r: r.dossier
    assert sorted(back.collect(), key=key) == sorted(cleaned.export.collect(), key=key)
    enriched = flow.enrich(back)
    tables.write_by_year(enriched, str(tmp_path / "enriched"))
    again = spark.read.parquet(str(tmp_path / "enriched"))
    assert again.filter("annee = 2023").count() == 4
    assert again.select("Jour_semaine").distinct().count() >= 1
    padded = back.withColumnRenamed("age", " age ")
    assert tables.trim_names(padded).columns == back.columns


def test_raw_sources(spark, tmp_path):
    one = raw(spark).filter("annee = 2023").drop("annee")
    one.write.parquet(str(tmp_path / "p"))
    one.write.option("header", True).csv(str(tmp_path / "c"))
    both = tables.read_raw_years(spark, {2023: str(tmp_path / "p"), 2024: str(tmp_path / "p")})
    assert both.count() == 80 and both.columns == ["row_no", *tables.RAW_COLUMNS, "annee"]
    csv = tables.read_raw_eav(spark, str(tmp_path / "c"), 2023, "csv")
    assert eav.normalised_visits(eav.clean_eav(csv)).count() == 5
    with pytest.raises(ValueError):
        tables.raw_eav(one.drop("row_no"), 2023)
    with pytest.raises(ValueError):
        tables.raw_eav(one.drop("titre"), 2023)
