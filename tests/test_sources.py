"""Readers and sinks: what can't be read is counted, what can comes back as it was."""

import datetime as dt

from recordloom.sources import tables

RAW = "row_no string, titre string, attribut string, patient string, dossier string, date_entree string, reponse string"


def test_raw_rejects_are_counted_and_left_out(spark, tmp_path):
    rows = [("1", "t", "a : b", None, "d", "x", ' "on" , yes '), ("two", "t", "a", None, "d", None, None), ("two", "t", "c", None, "d", None, None),
            (None, "t", "a", None, "d", None, None), ("9" * 30, "t", "a", None, "d", None, None)]
    path = str(tmp_path / "raw")
    tables.write_csv(spark.createDataFrame(rows, RAW), path)
    read = tables.read_raw_checked(spark, path, 2023)
    got = read.rows.collect()
    assert [(r.row_no, r.reponse, r.annee) for r in got] == [(1, ' "on" , yes ', 2023)]
    assert sorted(map(tuple, read.rejects.collect())) == [("row_no", "(none)", 1), ("row_no", "9" * 30, 1), ("row_no", "two", 2)]
    assert read.rejects.columns == ["colonne", "valeur", "n"]


def test_clean_rejects(spark, tmp_path):
    kinds = dict(part.split() for part in tables.CLEAN_SCHEMA.split(", "))
    values = [
        {"dossier": "D1", "annee": "2023", "age": "30", "age_imp": "30.5", "date_entree": "2023-09-01 08:15:00"},
        {"dossier": "D2", "annee": "MMXXIII", "age": "trente", "age_imp": "", "date_entree": "hier"},
        {"dossier": "D3", "annee": "2024", "age": "trente", "age_imp": None, "date_entree": None},
    ]
    rows = [tuple(v.get(c) for c in kinds) for v in values]
    path = str(tmp_path / "clean")
    tables.write_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in kinds)), path)
    read = tables.read_clean_checked(spark, path)
    got = {r.dossier: (r.annee, r.age, r.age_imp, r.date_entree) for r in read.rows.collect()}
    assert got == {"D1": (2023, 30, 30.5, dt.datetime(2023, 9, 1, 8, 15)), "D2": (None, None, None, None), "D3": (2024, None, None, None)}
    assert sorted(map(tuple, read.rejects.collect())) == [("age", "trente", 2), ("annee", "MMXXIII", 1), ("date_entree", "hier", 1)]
    clean = tables.read_clean_checked(spark, path)
    tables.write_csv(clean.rows, str(tmp_path / "again"))
    assert tables.read_clean_checked(spark, str(tmp_path / "again")).rejects.count() == 0


def test_blanks_and_quotes_survive_a_csv_round_trip(spark, tmp_path):
    rows = [(1, " a  ", 'say "x"', "back\\slash"), (2, "a,b;c", "é😀", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    tables.write_csv(df, str(tmp_path / "t"))
    back = spark.read.options(**tables._CSV).csv(str(tmp_path / "t")).collect()
    assert sorted((int(r.i), r.a, r.b, r.c) for r in back) == rows


def test_compressed_export_reads_the_same_and_is_smaller(spark, tmp_path):
    rows = [(i, "t", "Sexe : Homme", None, f"D{i}", "03/09/2023", "on, \"x\"") for i in range(3000)]
    raw = spark.createDataFrame(rows, tables.RAW_SCHEMA).coalesce(1)
    size, read = {}, {}
    for kind in (None, "gzip"):
        path = str(tmp_path / str(kind))
        tables.write_csv(raw, path, compression=kind)
        size[kind] = sum(f.stat().st_size for f in (tmp_path / str(kind)).glob("part-*"))
        read[kind] = sorted(map(tuple, tables.read_raw_eav(spark, path, 2023, "csv").collect()), key=repr)
    assert read[None] == read["gzip"] and len(read["gzip"]) == 3000
    assert size["gzip"] * 4 < size[None]
