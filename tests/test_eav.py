import datetime as dt

from recordloom.operators import eav
from recordloom.sources import tables

DIAG = "Diagnostic retenu ou évoqué"


def raw_rows():
    rows = [
        # attribut, dossier, date, answer
        ("Identifiant : Prénom", "d2", None, None),
        ("Identifiant : Prénom", "d2", "bad", " Awa "),
        ("Identifiant : Prénom", "d2", "13/09/2023", "Other"),
        ("Identifiant : Nom", "d2", None, "Diop"),
        ("Identifiant : Age", "d2", None, "16 ans"),
        ("Identifiant : Identifiant (U/E/P/M)", "d2", None, "p-17"),
        ("Sexe : Homme", "d2", None, None),
        ("Sexe : Femme", "d2", None, "On"),
        (f"{DIAG} : Affections ORL", "d2", None, "on"),
        (f"{DIAG} : Accident moto", "d2", None, "on"),
        (f"{DIAG} : Affections urologiques", "d2", None, "off"),
        (f"{DIAG} no colon", "d2", None, "on"),
        ("Service : Urologie", "d2", None, "on"),
        ("Service : Autres", "d2", None, "on"),
        ("Sexe : Homme", "  ", None, "on"),
        ("Sexe : Homme", "d1", "03-09-2023 07:30", "on"),
        ("Sexe : Femme", "d1", None, "on"),
        ("Trancheddge : C", "d1", None, "on"),
        ("Tranche age : B", "d1", None, "on"),
        ("Tranche age : A", "d1", None, "on"),
        ("Tranche d'âge : Z", "d1", None, "on"),
        (f"{DIAG} : inconnu", "d1", None, "on"),
        ("Motif", "d0", None, None),
    ]
    return [(i, "t", a, "p", d, date, r) for i, (a, d, date, r) in enumerate(rows)]


def make(spark):
    raw = tables.raw_eav(spark.createDataFrame(raw_rows(), tables.RAW_SCHEMA), 2023)
    return eav.clean_eav(raw.repartition(5))


def test_clean(spark):
    rows = make(spark).orderBy("row_no").collect()
    assert len(rows) == 22
    assert (rows[0].cat_slug, rows[0].item_slug, rows[0].reponse_on) == ("identifiant", "prenom", False)
    assert rows[7].reponse_on and rows[11].item is None and rows[11].item_slug == ""


def test_pivot(spark):
    out = {r.dossier: r for r in eav.pivot_visits(make(spark)).collect()}
    assert set(out) == {"d0", "d1", "d2"}
    d2 = out["d2"]
    assert (d2.prenom, d2.nom, d2.age, d2.type_patient_code) == ("Awa", "Diop", 16, "P")
    # The unreadable first date is not replaced by a later readable one.
    assert d2.date_entree is None and d2.visit_no == 0
    assert d2.diagnostic == ["Affections ORL", "Accident moto"]
    assert d2.service == ["Urologie", "Autres"] and d2.provenance is None
    d1 = out["d1"]
    assert d1.tranche_age == ["B", "A", "C"] and d1.sexe_brut == ["Homme", "Femme"]
    assert d1.date_entree == dt.datetime(2023, 9, 3, 7, 30)
    assert out["d0"].sexe_brut is None and out["d0"].annee == 2023


def test_extra_keys(spark):
    keys = {**eav.LIST_COLUMNS, **eav.EXTRA_KEYS}
    out = {r.dossier: r for r in eav.pivot_visits(make(spark), keys).collect()}
    assert out["d1"].tranche_age == ["B", "A", "C", "Z"]


def test_both_ways_to_normalised_visits_agree(spark):
    clean = make(spark)
    direct = eav.normalised_visits(clean)
    by_lists = eav.normalise_lists(eav.pivot_visits(clean)).select(direct.columns)
    key = lambda r: r.dossier
    one, two = sorted(direct.collect(), key=key), sorted(by_lists.collect(), key=key)
    assert one == two
    d0, d1, d2 = one
    assert (d2.sexe, d2.sexe_concordant, d2.diagnostic_categorie, d2.trauma_type) == (
        "Femme", True, "TRAUMA", "Accident moto")
    assert (d2.service_principal, d2.type_patient, d2.categorie_diagnostique_large) == (
        "Urologie", "Pediatrie", "Pediatrie")
    assert d2.nom_complet_norm == "awa diop"
    assert (d1.sexe, d1.sexe_concordant, d1.diagnostic_categorie, d1.tranche_age_declaree) == (
        None, False, "AUTRE", "B")
    assert (d0.diagnostic_categorie, d0.categorie_diagnostique_large, d0.nom_complet_norm) == (None, "Medical", "")


def test_long_form(spark):
    rows = eav.ticked_answers(make(spark)).filter("colonne = 'tranche_age'").orderBy("key_rank", "row_no").collect()
    assert [r.item for r in rows] == ["B", "A", "C"]


def test_plans_stay_in_the_jvm(spark, capsys, tmp_path):
    make(spark).write.partitionBy("annee").parquet(str(tmp_path / "eav"))
    eav.normalised_visits(spark.read.parquet(str(tmp_path / "eav"))).explain()
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan
    assert plan.count("Exchange hashpartitioning(annee") == 1
    # Columns no later stage uses are not read.
    schema = plan[plan.index("ReadSchema"):]
    assert "titre" not in schema and "patient" not in schema


def test_answers_are_sorted_by_a_hash_of_their_visit(spark):
    """The sort below the aggregation starts with eight bytes that tell visits apart, not with the year."""
    import re

    from recordloom.operators import eav as module

    raw = spark.createDataFrame(
        [(1, "t", "Service : A", None, "D1", None, "on", 2023)],
        "row_no bigint, titre string, attribut string, patient string, dossier string, date_entree string, reponse string, annee int",
    )
    visits = module.normalised_visits(module.clean_eav(raw))
    plan = visits._jdf.queryExecution().executedPlan().toString()
    sorts = re.findall(r"Sort \[(\w+)#", plan)
    assert sorts and set(sorts) == {"_groupingexpression"}
    assert "_visit" not in visits.columns and visits.first()["service_principal"] == "A"


def test_visits_are_aggregated_from_narrow_rows(spark):
    """Rows carry numbers for keys, and a first answer stands once beside its place in the order."""
    plan = eav.normalised_visits(make(spark))._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in plan.splitlines() if "partial_min(" in line)
    assert "cat_slug" not in partial and "item_slug" not in partial and "reponse_on" not in partial
    assert "min_by" not in partial and "bool_or" not in partial and "partial_max" not in partial
    assert partial.count("partial_bit_or") == 1


def test_lists_are_collected_together_from_narrow_rows(spark):
    """Rows enter the aggregation with what it reads; lists nobody reads are not collected."""
    clean = make(spark)
    plan = eav.normalise_lists(eav.pivot_visits(clean)).drop("antecedents", "motif_consultation")
    read = [c for c in eav.normalised_visits(clean).columns]
    partial = plan.select(read)._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in partial.splitlines() if "partial_min(" in line)
    assert partial.count("partial_collect_list") == 1
    assert "cat_slug" not in partial and "item_slug" not in partial and "reponse_on" not in partial
    # An answer is not kept beside its place in the order.
    assert "min_by" not in partial
    full = eav.pivot_visits(clean)._jdf.queryExecution().executedPlan().toString()
    full = next(line for line in full.splitlines() if "partial_min(" in line)
    assert full.count("partial_collect_list") == 2


def test_lists_of_a_visit_with_repeated_and_missing_row_numbers(spark):
    schema = (
        "row_no bigint, attribut string, categorie string, item string, cat_slug string, item_slug string, "
        "patient string, dossier string, date_entree string, reponse string, reponse_on boolean, annee int"
    )
    answers = [
        (7, "service", "B", None), (7, "service", "A", None), (None, "service", "Z", None), (3, "service", "A", None),
        (9, "trancheage", "old", None), (1, "trancheddge", "first by row", None), (9, "typedetraitement", "T", None),
        (2, "service", None, None), (5, "autre", "X", "03-09-2023 07:30"), (5, "autre", "W", "04-09-2023 07:30"),
    ]
    rows = [(n, k, k, i, k, i, None, "d", date, "on", True, 2023) for n, k, i, date in answers]
    out = eav.pivot_visits(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert len(out) == 1 and (out[0].visit_no, out[0].n_lignes) == (1, 10)
    assert out[0].service == ["Z", "A", "A", "B"] and out[0].tranche_age == ["old", "first by row"]
    assert out[0].type_traitement == ["T"] and out[0].diagnostic is None
    assert out[0].date_entree == dt.datetime(2023, 9, 4, 7, 30)


def test_orders_that_become_answers_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """A split of a file says nothing of the answers its orders become."""
    from pyspark.sql import functions as F

    from workload import shapes

    spark.range(1000).selectExpr(
        "id AS o_orderkey", "id % 50 AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
        "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "'S' AS c_mktsegment").write.parquet(
        str(tmp_path / "customer.parquet"))
    spark.range(100).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "'A' AS l_returnflag").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    few = shapes.raw_answers(spark, str(tmp_path), whole=True)
    monkeypatch.setattr(shapes, "VISITS_A_TASK", 50)
    many = shapes.raw_answers(spark, str(tmp_path), whole=True)
    answered = many.filter("titre = 'orders'").groupBy(F.spark_partition_id()).agg(F.count_distinct("dossier").alias("n"))
    assert answered.agg(F.max("n")).first()[0] <= 60
    assert many.count() == 22 * 1000 + 100
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
