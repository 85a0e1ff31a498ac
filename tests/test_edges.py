"""Inputs at the edge: gaps, reordered columns, real times, empty years, crowded keys."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recordloom import session
from recordloom.functions import labels, tails, text, typed
from recordloom.operators import compare, counts, dedup, eav, impute
from recordloom.sources import tables

YEARS = (2023, 2024)


def test_unknown_code_gives_no_sex(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (0.4,), (0.6,), (9.0,)], "c double")
    got = [r[0] for r in df.select(impute.sex_from_code(F.col("c"))).collect()]
    assert got == [None, labels.MALE, labels.MALE, labels.FEMALE, labels.FEMALE]


def test_chained_regressions_leave_a_year_without_ages_alone(spark):
    rows = [(2023, None, None, "A"), (2023, None, labels.MALE, "A"), (2024, 30, labels.MALE, "A"), (2024, None, labels.MALE, None)]
    df = spark.createDataFrame(rows, "annee int, age int, sexe string, diagnostic_categorie string")
    got = {(r.annee, r.sexe): (r.age_imp, r.sexe_imp) for r in impute.mice(df.filter("annee = 2023")).collect()}
    assert got[(2023, None)] == (None, None)
    assert got[(2023, labels.MALE)] == (None, labels.MALE)
    filled = impute.mice(df.filter("annee = 2024")).collect()
    assert [r.age_imp for r in filled] == [30.0, 30.0]


def test_chained_regressions_take_many_groups(spark):
    n = 25_000
    df = spark.range(2 * n).select(
        (F.col("id") % n).cast("int").alias("annee"),
        F.when(F.col("id") < n, F.col("id") % 90).cast("int").alias("age"),
        F.lit(labels.MALE).alias("sexe"), F.lit("A").alias("diagnostic_categorie"),
    )
    out = impute.mice(df)
    assert out.filter("age_imp is null").count() == 0
    assert out.filter("age is null and age_imp <> annee % 90").count() == 0


def test_clean_table_is_read_by_name(spark, tmp_path):
    names = [c for c in tables.CLEAN_COLUMNS if c != "trauma_type"]
    swapped = [names[1], names[0], *names[2:], "extra"]
    value = {c: "x" for c in swapped} | {"dossier": "D1", "annee": "2023", "age": "30", "age_imp": "bad", "date_entree": "2023-09-01 08:15:00"}
    df = spark.createDataFrame([tuple(value[c] for c in swapped)], [f" {c} " for c in swapped])
    df.write.option("header", True).csv(str(tmp_path / "clean"))
    row = tables.read_clean(spark, str(tmp_path / "clean")).first()
    assert (row.dossier, row.annee, row.age, row.age_imp, row.trauma_type) == ("D1", 2023, 30, None, None)
    assert row.date_entree == datetime(2023, 9, 1, 8, 15)
    df.drop(" dossier ").write.option("header", True).csv(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="dossier"):
        tables.read_clean(spark, str(tmp_path / "short"))


@pytest.mark.parametrize("day_first", [False, True])
def test_real_times_are_never_turned_around(spark, day_first):
    df = spark.sql("select 1L row_no, 'a' t, 'b' u, 'c' p, 'd' d, timestamp_ntz'2023-09-03 10:00:00.25' e, 'r' r")
    raw = tables.raw_eav(df, 2023)
    got = raw.select(typed.parse_entry_date(F.col("date_entree"), day_first)).first()[0]
    assert got == datetime(2023, 9, 3, 10, 0, 0, 250000)


SCHEMA = "annee int, age double, sexe string"


@pytest.mark.parametrize("rows", [
    [(2023, 1.0, "a"), (2023, 2.0, "b")],
    [(2023, 1.0, "a"), (2024, 1.0, "a"), (2023, 1.0, "a"), (2024, 1.0, "a")],
    [],
])
def test_statistics_answer_without_data_or_spread(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    t = compare.mean_test(df, "age", YEARS)
    assert t["test"] == "Welch" and t["t"] is None and t["p_value"] is None
    z = compare.two_proportion_z(df, F.col("sexe") == "none", YEARS)
    assert z["z"] is None and z["p_value"] is None
    assert compare.levene(df, "age", YEARS)["p_value"] is None
    chi = compare.chi_square(df, "sexe", YEARS)
    assert (chi["p_value"] is None) == (len(rows) != 4)


def test_one_category_cannot_differ(spark):
    df = spark.createDataFrame([(2023, 1.0, "a"), (2024, 2.0, "a")], SCHEMA)
    assert compare.chi_square(df, "sexe", YEARS) == {"chi2": 0.0, "dof": 0, "p_value": 1.0}


def test_tails_at_large_degrees_of_freedom():
    for t in (0.1, 1.96, 4.0):
        assert math.isclose(tails.t_two_sided(t, 1e12), tails.normal_two_sided(t), rel_tol=1e-9)
        assert math.isclose(tails.t_two_sided(t, 1.01e7), tails.t_two_sided(t, 0.99e7), rel_tol=1e-6)
        assert math.isclose(tails.f_upper(t * t, 1, 1e12), tails.normal_two_sided(t), rel_tol=1e-9)


def test_attribute_missing_from_the_snapshot_keeps_its_row(spark):
    rows = [(1, "Sexe : Homme", "p", "d", "x"), (2, "Identifiant : nom", "p", "d", "x"), (3, None, "p", "d", "x")]
    raw = spark.createDataFrame(rows, "row_no long, attribut string, patient string, dossier string, reponse string")
    cells = raw.withColumn("reponse_on", text.is_ticked(F.col("reponse")))
    seen = raw.filter("row_no = 1").select("attribut").collect()
    got = eav._with_known_keys(cells, seen, True)
    want = eav._with_attribute_keys(cells, True)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert got.select(order).orderBy("row_no").collect() == want.select(order).orderBy("row_no").collect()


def test_crowded_keys_are_salted_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE_ROWS", 8)
    left = spark.range(100).select(F.col("id").alias("cell"), (F.col("id") % 3).alias("k"))
    want = dedup._tiled_join(left, left, ["k"], F.lit(True)).count()
    monkeypatch.setattr(dedup, "few_rows_or_none", lambda df: None)
    got = dedup._tiled_join(left, left, ["k"], F.lit(True)).select(F.col("l.cell"), F.col("r.cell"))
    assert got.count() == want == 34 * 34 + 2 * 33 * 33
    assert got.distinct().count() == want


def test_shares_have_no_window(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    out = counts.shares(df, "v")
    assert "Window" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [("a", 2, 66.7), ("b", 1, 33.3)]


def test_intermediate_tables_leave_the_settings_alone(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    session.shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
