"""The shared tables in the shapes the engine works on, in Spark and in SQL.

Every shape uses the whole table. The tables hold few NULLs, so gaps are put
into *values* by key arithmetic; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import in_tasks_of, spread

YEARS = (2023, 2024)
# An order becomes up to 22 answers in its task. With no more visits than an
# aggregation with lists holds (``session.keep_lists_hashed``), none are sorted.
VISITS_A_TASK = 30_000

# Answer labels as they appear on a form.
ANSWER_LABELS = (
    "Coup et blessures",
    "Accidents domestiques",
    "Accidents de la circulation",
    "Accident moto",
    "Accident charrette",
    "Affections cardio-vasculaires",
    "Diabète et autres affections métaboliques",
    "Cas suspect de paludisme",
    "Cas confirmé de paludisme",
    "Cas suspect COVID-19",
    "Cas confirmé de COVID-19",
    "Affections respiratoires",
    "Gastro-entérite aigu/intoxication",
    "Affections digestives",
    "Affections bucco-dentaires",
    "Affections ophtalmologiques",
    "Affections obstétricales",
    "Affections gynécologiques",
    "Affections urologiques",
    "Affections rhumatologiques",
    "Affections dermatologiques",
    "Affections neuro-psychatriques",
    "Coup de chaleur",
    "Affections ORL",
    "Arrivé décédé (corps sans vie)",
    "Si autre, préciser",
    "Observation",
    "Fatigue",
    "Contrôle",
    "Vaccination",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- raw answers: one visit per order ---------------------------------------

# (attribute, answer) of the rows an order gives; both are SQL that Spark and
# the oracle share.
_ORDER_ANSWERS = (
    ("'Identifiant : Prénom'", "c_mktsegment"),
    ("'Identifiant : Nom'", "c_name"),
    ("'Identifiant : Age'", "CASE WHEN o_orderkey % 7 <> 0 THEN concat(o_custkey % 97, ' ans') END"),
    (
        "'Identifiant : Identifiant patient'",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'u-1' WHEN '2' THEN 'E2' WHEN '3' THEN ' p3' WHEN '4' THEN 'M4' ELSE 'x5' END",
    ),
    ("'Sexe : Homme'", "CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 11 = 0 THEN 'on' END"),
    ("'Sexe : Femme'", "CASE WHEN o_custkey % 2 = 1 OR o_orderkey % 11 = 0 THEN ' ON ' END"),
    ("concat('Service : ', o_orderpriority)", "'on'"),
    (
        "concat('Typologie  du cas : ', CASE WHEN o_orderstatus = 'F' THEN 'cas simple' ELSE 'cas grave' END)",
        "CASE WHEN o_orderstatus <> 'P' THEN 'on' END",
    ),
    ("'Evolution immédiate dans les 24h : favorable'", "CASE WHEN o_totalprice > 250000 THEN 'on' ELSE 'off' END"),
    (
        "concat('Durée approximative d’hospitalisation : ', CASE WHEN o_totalprice > 400000 THEN '4-7j' ELSE '0-3j' END)",
        "CASE WHEN o_totalprice > 300000 THEN 'on' END",
    ),
    ("concat('Provenance : ', c_mktsegment)", "CASE WHEN o_orderkey % 5 <> 0 THEN 'on' END"),
    ("'AntÈcÈdents pathologiques : HTA'", "CASE WHEN o_orderstatus = 'O' THEN 'on' END"),
)


# Rows of the form's other questions, for the queries that show all answer lists.
_MORE_ANSWERS = (
    ("concat('Trancheddge : ', 10 * (o_custkey % 7), ' ans')", "CASE WHEN o_orderkey % 4 = 0 THEN 'on' END"),
    ("concat('Tranche age : ', 10 * (o_custkey % 9), ' ans')", "CASE WHEN o_orderkey % 3 = 0 THEN 'on' END"),
    ("concat('Tranche da : ', 10 * (o_custkey % 8), ' ans')", "CASE WHEN o_orderkey % 6 = 0 THEN 'on' END"),
    ("concat('Motif de consultation : ', c_mktsegment)", "CASE WHEN o_orderkey % 2 = 0 THEN 'on' END"),
    ("concat('Conduite   tenir : ', o_orderpriority)", "'ON'"),
    ("concat('Explorations biologiques : NFS ', o_custkey % 5)", "CASE WHEN o_orderkey % 7 = 0 THEN 'on' END"),
    ("concat('Explorations radiologiques : radio ', o_custkey % 3)", "CASE WHEN o_orderkey % 8 = 0 THEN 'on' ELSE 'non' END"),
    ("'Hospitalisation/Evacuation : hospitalisation'", "CASE WHEN o_totalprice > 200000 THEN 'on' END"),
    ("'Type de traitement : perfusion'", "CASE WHEN o_orderstatus = 'O' THEN 'on' END"),
    ("'Type de traitement : antalgique'", "CASE WHEN o_custkey % 3 = 0 THEN 'on' END"),
)


def _entry_date(day: str, iso: str, clock: str) -> str:
    return f"CASE WHEN o_orderkey % 3 = 0 THEN concat({iso}, {clock}) ELSE concat({day}, {clock}) END"


_CLOCK = "' ', lpad(CAST(o_orderkey % 24 AS {text}), 2, '0'), ':30'"


def raw_answers(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Orders and customers as identity and tick rows, line items as diagnosis ticks.

    ``whole`` adds the form's other questions, so that every list is filled.
    """
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    same = F.col("o_custkey") == F.col("c_custkey")
    n_orders = orders.count()
    if n_orders > VISITS_A_TASK * spark.sparkContext.defaultParallelism:
        # After the join, whose own shuffle would undo it.
        orders = in_tasks_of(orders.join(customers, same, "left"), n_orders, VISITS_A_TASK)
    else:
        orders = spread(orders).join(customers, same, "left")
    date = _entry_date(
        "date_format(o_orderdate, 'dd/MM/yyyy')", "date_format(o_orderdate, 'yyyy-MM-dd')", _CLOCK.format(text="string")
    )
    structs = F.array(*[
        F.struct(F.lit(k).alias("k"), F.expr(attribute).alias("attribut"), F.expr(answer).alias("reponse"))
        for k, (attribute, answer) in enumerate(_ORDER_ANSWERS + (_MORE_ANSWERS if whole else ()))
    ])
    # What all answers of an order share is worked out once, before they become rows.
    shared = orders.select(
        (F.col("o_orderkey") * 64).alias("first_no"),
        F.concat(F.lit("D"), F.col("o_orderkey")).alias("dossier"),
        F.expr(date).alias("date_entree"),
        (F.lit(YEARS[0]) + F.col("o_orderkey") % 2).cast("int").alias("annee"),
        structs.alias("answers"),
    )
    from_orders = shared.select("first_no", "dossier", "date_entree", "annee", F.inline("answers")).select(
        (F.col("first_no") + F.col("k")).alias("row_no"),
        F.lit("orders").alias("titre"),
        "attribut",
        F.lit(None).cast("string").alias("patient"),
        "dossier",
        "date_entree",
        "reponse",
        "annee",
    )
    label = F.try_element_at(F.array(*map(F.lit, ANSWER_LABELS)), (F.col("l_partkey") % len(ANSWER_LABELS) + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    from_lines = spread(lines).select(
        (F.col("l_orderkey") * 64 + 32 + F.col("l_linenumber")).alias("row_no"),
        F.lit("lineitem").alias("titre"),
        F.concat(F.lit("Diagnostic retenu ou évoqué : "), label).alias("attribut"),
        F.lit(None).cast("string").alias("patient"),
        F.concat(F.lit("D"), F.col("l_orderkey")).alias("dossier"),
        F.lit(None).cast("string").alias("date_entree"),
        F.when(F.col("l_returnflag") != "N", F.lit("on")).alias("reponse"),
        (F.lit(YEARS[0]) + F.col("l_orderkey") % 2).cast("int").alias("annee"),
    )
    return from_orders.unionByName(from_lines)


def _raw_answers_sql(whole: bool = False) -> str:
    date = _entry_date(
        "strftime(o_orderdate, '%d/%m/%Y')", "strftime(o_orderdate, '%Y-%m-%d')", _CLOCK.format(text="VARCHAR")
    )
    per_order = " UNION ALL ".join(
        f"SELECT o_orderkey * 64 + {k} AS row_no, {attribute} AS attribut, o_orderkey AS k, "
        f"{date} AS date_entree, {answer} AS reponse, FALSE AS from_lines FROM o"
        for k, (attribute, answer) in enumerate(_ORDER_ANSWERS + (_MORE_ANSWERS if whole else ()))
    )
    return f"""
o AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
raw AS (
  SELECT row_no, attribut, concat('D', k) AS dossier, date_entree, reponse, from_lines, CAST({YEARS[0]} + k % 2 AS INTEGER) AS annee
  FROM ({per_order} UNION ALL
    SELECT l_orderkey * 64 + 32 + l_linenumber, concat('Diagnostic retenu ou évoqué : ',
           ({_sql_list(ANSWER_LABELS)})[CAST(l_partkey % {len(ANSWER_LABELS)} + 1 AS INTEGER)]), l_orderkey, NULL,
           CASE WHEN l_returnflag <> 'N' THEN 'on' END, TRUE FROM lineitem) u
)"""


# --- visits from parts: many lookalikes -------------------------------------

def part_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as visits: name, brand as sex, size as age, an hour within four days."""
    key = F.col("p_partkey")
    moment = F.expr("timestampadd(HOUR, CAST(p_partkey % 96 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
    return table(spark, sf_dir, "part").select(
        (F.lit(YEARS[0]) + key % 2).cast("int").alias("annee"),
        key.alias("visit_no"),
        F.lower("p_name").alias("nom_complet_norm"),
        F.col("p_brand").alias("sexe"),
        F.when(key % 13 != 0, F.col("p_size")).alias("age"),
        F.when(key % 5 != 0, moment).alias("date_entree"),
    )


PART_VISITS_SQL = f"""
visits AS (
  SELECT CAST({YEARS[0]} + p_partkey % 2 AS INTEGER) AS annee, p_partkey AS visit_no, lower(p_name) AS nom_complet_norm,
         p_brand AS sexe, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS age,
         CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (p_partkey % 96) END AS date_entree
  FROM part
)"""


# --- visits from events: gaps to fill ---------------------------------------

# Event type -> category.
_EVENT_CATEGORIES = (("click", "TRAUMA"), ("error", "DIGESTIF"), ("purchase", "ORL"), ("signup", "RESPIRATOIRE"), ("view", "AUTRE"))


def _event_columns(least: str) -> dict[str, str]:
    """Columns in SQL both sides share."""
    category = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_CATEGORIES)
    category = f"CASE event_type {category} END"
    broad = f"CASE {category} WHEN 'TRAUMA' THEN 'Trauma' ELSE 'Medical' END"
    sex = "CASE WHEN user_id % 2 = 0 THEN 'Homme' ELSE 'Femme' END"
    return {
        "annee": f"CAST({YEARS[0]} + event_id % 2 AS INTEGER)",
        "visit_no": "event_id",
        "dossier": "concat('V', event_id)",
        "age": f"CASE WHEN event_id % 7 <> 0 THEN CAST({least}(floor(value / 2) + 9 * (user_id % 2), 110) AS INTEGER) END",
        "sexe": f"CASE WHEN event_id % 9 <> 0 THEN {sex} END",
        "sexe_concordant": "event_id % 9 <> 0",
        "diagnostic_categorie": f"CASE WHEN event_id % 4 <> 0 THEN {category} END",
        "trauma_type": f"CASE WHEN {category} = 'TRAUMA' AND event_id % 4 <> 0 THEN concat('cause ', user_id % 5) END",
        "categorie_diagnostique_large": broad,
        "service_principal": "CASE WHEN event_id % 6 <> 0 THEN concat('service ', user_id % 19) END",
        "typologie_cas": "CASE WHEN event_id % 5 <> 0 THEN 'cas simple' WHEN event_id % 2 = 0 THEN 'cas grave' END",
        "evolution_immediate": "CASE WHEN event_id % 3 = 0 THEN event_type END",
        "duree_hospitalisation": "CASE WHEN event_id % 8 = 0 THEN '0-3j' WHEN event_id % 8 = 1 THEN '4-7j' END",
        "date_entree": "CASE WHEN event_id % 10 <> 0 THEN ts END",
    }


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.expr(sql).alias(name) for name, sql in _event_columns("least").items()]
    return table(spark, sf_dir, "events").select(*columns)


EVENT_VISITS_SQL = (
    "visits AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _event_columns("least").items()) + " FROM events)"
)

RAW_ANSWERS_SQL = _raw_answers_sql()
ALL_ANSWERS_SQL = _raw_answers_sql(whole=True)
