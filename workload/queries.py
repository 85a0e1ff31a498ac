"""Every operator as a query over the shared tables, with its SQL twin.

Keys start with the operator's identifier. ``QUERIES`` maps a key to a function
of (session, folder); ``ORACLE`` maps it to SQL where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import labels, similarity, text, typed
from recordloom.operators import compare, counts, dedup, eav, impute
from recordloom.plans import cleaning, flow, quality
from recordloom.session import new_table_path, spread, staged
from recordloom.sources import tables

from . import twins as t
from .shapes import (
    ALL_ANSWERS_SQL,
    EVENT_VISITS_SQL,
    PART_VISITS_SQL,
    RAW_ANSWERS_SQL,
    YEARS,
    event_visits,
    part_visits,
    raw_answers,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
Y1, Y2 = YEARS


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


# --- text and typing --------------------------------------------------------

def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query("f1_encoding_repair", f"SELECT doc_id, {t.repaired('text')} AS repaired FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", text.repair_encoding(F.col("text")).alias("repaired"))


@query("f2_clean_text", f"SELECT doc_id, {t.cleaned('text')} AS cleaned FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("f3_slug_key", f"SELECT doc_id, {t.slug('text')} AS slug FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", text.slug(F.col("text")).alias("slug"))


_TURN = "concat(role, ' : ', turn, ' : ', text)"


@query(
    "f4_attribute_split",
    f"""SELECT conv_id, turn, trim(split_part(a, ':', 1)) AS categorie,
        CASE WHEN strpos(a, ':') > 0 THEN trim(substring(a, strpos(a, ':') + 1)) END AS item
        FROM (SELECT *, {t.cleaned(_TURN)} AS a FROM conversations) c""",
)
def _(spark, sf):
    attribute = text.clean_text(F.expr(_TURN))
    rows = table(spark, sf, "conversations").withColumn("a", attribute)
    return rows.select(
        "conv_id", "turn",
        text.attribute_category(F.col("a")).alias("categorie"), text.attribute_item(F.col("a")).alias("item"),
    )


@query(
    "f5_p1_clean_answers",
    f"""WITH {RAW_ANSWERS_SQL}, {t.CLEAN_ANSWERS_SQL}
        SELECT annee, cat_slug, reponse_on, count(*) AS n, count(DISTINCT item_slug) AS n_items FROM eav GROUP BY ALL""",
)
def _(spark, sf):
    clean = eav.clean_eav(raw_answers(spark, sf))
    return clean.groupBy("annee", "cat_slug", "reponse_on").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("item_slug").alias("n_items")
    )


_AGE = "TRY_CAST(regexp_extract(text, '([0-9]{1,3})', 1) AS INTEGER)"


@query("f6_age_parse", f"SELECT doc_id, CASE WHEN {_AGE} BETWEEN 0 AND 120 THEN {_AGE} END AS age FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", typed.age_from_text(F.col("text")).alias("age"))


# Ways of writing the date of an order, as a Spark pattern or expression, and
# what is read: days and hours after the date, or the first of its month.
_DATE = "date_format(o_orderdate, '{}')"
_WRITTEN_DATES = (
    (_DATE.format("dd/MM/yyyy"), "d"), (_DATE.format("yyyy-MM-dd"), "d"), (_DATE.format("d-M-yyyy"), "d"),
    (f"concat({_DATE.format('dd.MM.yyyy')}, ' ', o_orderkey % 24, ':00')", "d + INTERVAL 1 HOUR * (o_orderkey % 24)"),
    (f"concat('vers ', {_DATE.format('MMMM yyyy')})", "NULL"),
    (f"concat({_DATE.format('dd/MM/')}, right(year(o_orderdate), 2))", "d"),
    (_DATE.format("d MMM yyyy"), "d"), (f"concat({_DATE.format('MMMM d, yyyy')}, ' 9:05 pm')", "d + INTERVAL 1265 MINUTE"),
    (_DATE.format("yyyyMMdd"), "d"), (f"concat({_DATE.format('yyyyMMdd')}, 'T101112')", "d + INTERVAL 36672 SECOND"),
    (f"concat({_DATE.format('yyyy-MM-dd')}, ' 10:11:12.5')", "d + INTERVAL 36672500 MILLISECOND"),
    (f"concat({_DATE.format('yyyy-MM-dd')}, 'T10:11:12.000250+02:00')", "d + INTERVAL 36672000250 MICROSECOND"),
    (f"concat({_DATE.format('yyyy-MM-dd')}, 'T10:11Z')", "d + INTERVAL 611 MINUTE"),
    (f"concat({_DATE.format('EEEE d MMMM yyyy')}, ' 10h30')", "d + INTERVAL 630 MINUTE"),
    (_DATE.format("MMMM yyyy"), "date_trunc('month', d)"), (_DATE.format("yyyy-MM"), "date_trunc('month', d)"),
    (_DATE.format("MM/yyyy"), "date_trunc('month', d)"), (_DATE.format("yyyy"), "date_trunc('year', d)"),
)


@query(
    "f7_date_parse",
    f"SELECT o_orderkey, strftime(CASE o_orderkey % {len(_WRITTEN_DATES)} "
    + " ".join(f"WHEN {i} THEN {read}" for i, (_, read) in enumerate(_WRITTEN_DATES))
    + " END, '%Y-%m-%d %H:%M:%S.%f') AS entree FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders) o",
)
def _(spark, sf):
    forms = " ".join(f"WHEN {i} THEN {written}" for i, (written, _) in enumerate(_WRITTEN_DATES))
    parsed = typed.parse_entry_date(F.expr(f"CASE o_orderkey % {len(_WRITTEN_DATES)} {forms} END"))
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("entree"))


_CODE_TEXT = "concat(CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END, lower(substring(o_orderpriority, 3)))"


@query(
    "f8_f10_type_code",
    f"""SELECT o_orderkey, code, {t.mapped('code', labels.PATIENT_TYPES)} AS libelle FROM
        (SELECT o_orderkey, nullif(regexp_extract(upper({_CODE_TEXT}), '^\\s*([UEPM])', 1), '') AS code FROM orders) o""",
)
def _(spark, sf):
    coded = table(spark, sf, "orders").select("o_orderkey", typed.patient_type_code(F.expr(_CODE_TEXT)).alias("code"))
    return coded.withColumn("libelle", labels.patient_type(F.col("code")))


@query(
    "f14_f15_name_block",
    f"""SELECT c_custkey, trim(concat({t.slug('c_mktsegment')}, ' ', {t.slug('c_name')})) AS cle,
        {t.soundex(t.slug('c_mktsegment'))} AS bloc FROM customer""",
)
def _(spark, sf):
    key = labels.full_name_key(labels.name_key(F.col("c_mktsegment")), labels.name_key(F.col("c_name")))
    named = table(spark, sf, "customer").select("c_custkey", key.alias("cle"))
    return named.withColumn("bloc", similarity.block_key(F.col("cle")))


@query(
    "f16_jaro_winkler",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(jaro_winkler_similarity(p_name, lower(concat(s_name, l_returnflag, l_linestatus))), 6) AS sim
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
)
def _(spark, sf):
    lines = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    lines = lines.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(
        table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")
    )
    other = F.lower(F.concat("s_name", "l_returnflag", "l_linestatus"))
    pairs = lines.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", other.alias("other"))
    return pairs.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(similarity.jaro_winkler("p_name", "other"), 6).alias("sim")
    )


@query(
    "f17_f18_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, gap AS jours,
       round(0.7::DOUBLE * (1 - l_discount) + 0.2::DOUBLE * (1 - least(abs(l_linenumber - 4) / 2.0::DOUBLE, 1.0::DOUBLE)) + 0.1::DOUBLE * (1.0::DOUBLE - least(gap, 1)), 6) AS score
       FROM (SELECT *, abs(CAST(floor((epoch_us(o_orderdate + INTERVAL 1 HOUR * (l_partkey % 24)) - epoch_us(l_shipdate)) / 86400000000.0) AS BIGINT)) AS gap
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    moment = F.expr("timestampadd(HOUR, CAST(l_partkey % 24 AS INT), o_orderdate)")
    gap = similarity.day_gap(moment, F.col("l_shipdate"))
    score = similarity.composite(
        1 - F.col("l_discount"),
        similarity.age_score(F.abs(F.col("l_linenumber") - 4)),
        1.0 - F.least(gap, F.lit(1)),
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", gap.alias("jours"), F.round(score, 6).alias("score"))


@query(
    "f19_f20_enriched_visits",
    f"""WITH {EVENT_VISITS_SQL}
        SELECT dossier, extract(hour FROM date_entree) AS heure, dayname(date_entree) AS jour, strftime(date_entree, '%Y-%m-%d') AS date,
               {t.age_band('age')} AS tranche_age FROM visits""",
)
def _(spark, sf):
    rows = flow.enrich(event_visits(spark, sf))
    return rows.select(
        "dossier", F.col("Heure_entree").cast("bigint").alias("heure"), F.col("Jour_semaine").alias("jour"),
        F.col("Date").cast("string").alias("date"), "tranche_age",
    )


# --- pivot and harmonisation ------------------------------------------------

_ANSWERS = f"WITH {RAW_ANSWERS_SQL}, {t.CLEAN_ANSWERS_SQL}"
_VISITS = f"{_ANSWERS}, {t.PIVOT_SQL}"
# The same over the whole form, where every answer list is filled.
_ALL_ANSWERS = f"WITH {ALL_ANSWERS_SQL}, {t.CLEAN_ANSWERS_SQL}"
_ALL_VISITS = f"{_ALL_ANSWERS}, {t.PIVOT_SQL}"
_LISTS: dict[str, list[str]] = {}
for _key, _column in eav.LIST_COLUMNS.items():
    _LISTS.setdefault(_column, []).append(_key)


def _list_sql(*keys: str) -> str:
    rank = "CASE cat_slug " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(keys)) + " END"
    names = ", ".join(f"'{k}'" for k in keys)
    where = f"cat_slug IN ({names}) AND reponse_on AND item IS NOT NULL"
    return f"string_agg(item, '|' ORDER BY {rank}, row_no, item) FILTER (WHERE {where})"


@query(
    "a2_ticked_answers",
    f"""{_ALL_ANSWERS} SELECT annee, dossier, {t.mapped('cat_slug', eav.LIST_COLUMNS)} AS colonne,
        CAST({t.mapped('cat_slug', {k: str(i) for i, k in enumerate(eav.LIST_COLUMNS)})} AS INTEGER) AS key_rank, row_no, item
        FROM eav WHERE cat_slug IN ({', '.join(map(t.quoted, eav.LIST_COLUMNS))}) AND reponse_on AND item IS NOT NULL""",
)
def _(spark, sf):
    return eav.ticked_answers(eav.clean_eav(raw_answers(spark, sf, whole=True)))


@query(
    "a3_pivot_visits",
    f"""{_ALL_VISITS}, lists AS (SELECT annee, dossier, {', '.join(f'{_list_sql(*keys)} AS {column}' for column, keys in _LISTS.items())} FROM eav GROUP BY annee, dossier)
        SELECT v.annee, v.dossier, v.visit_no, f.prenom, f.nom, v.age, v.type_patient_code, strftime(v.date_entree, '%Y-%m-%d %H:%M') AS entree,
               {', '.join('l.' + column for column in _LISTS)}
        FROM visits v JOIN facts f ON f.annee = v.annee AND f.dossier = v.dossier JOIN lists l ON l.annee = v.annee AND l.dossier = v.dossier""",
)
def _(spark, sf):
    wide = eav.pivot_visits(eav.clean_eav(raw_answers(spark, sf, whole=True)))
    lists = [F.array_join(c, "|").alias(c) for c in _LISTS]
    entry = F.date_format("date_entree", "yyyy-MM-dd HH:mm").alias("entree")
    return wide.select("annee", "dossier", "visit_no", "prenom", "nom", "age", "type_patient_code", entry, *lists)


_NORMALISED = (
    "annee", "dossier", "visit_no", "age", "type_patient_code", "type_patient", "sexe", "sexe_concordant", "provenance", "service_principal",
    "tranche_age_declaree", "typologie_cas", "evolution_immediate", "duree_hospitalisation", "diagnostic_categorie", "trauma_type",
    "categorie_diagnostique_large", "nom_norm", "prenom_norm", "nom_complet_norm",
)
_NORMALISED_SQL = f"""{_ALL_VISITS}, more AS (
      SELECT annee, dossier, {t.slug('nom')} AS nom_norm, {t.slug('prenom')} AS prenom_norm, tranche AS tranche_age_declaree FROM facts
      JOIN (SELECT annee AS y, dossier AS d, split_part({_list_sql(*_LISTS['tranche_age'])}, '|', 1) AS tranche FROM eav GROUP BY 1, 2) b ON y = annee AND d = dossier)
    SELECT {', '.join(c if c not in ('annee', 'dossier') else 'v.' + c for c in _NORMALISED)}, strftime(date_entree, '%Y-%m-%d %H:%M') AS entree
    FROM visits v JOIN more m ON m.annee = v.annee AND m.dossier = v.dossier"""


def _normalised(visits: DataFrame) -> DataFrame:
    return visits.select(*_NORMALISED, F.date_format("date_entree", "yyyy-MM-dd HH:mm").alias("entree"))


@query("a1_f9_f13_normalised_visits", _NORMALISED_SQL)
def _(spark, sf):
    return _normalised(eav.normalised_visits(eav.clean_eav(raw_answers(spark, sf, whole=True))))


@query("f9_f11_f12_normalised_lists", _NORMALISED_SQL)
def _(spark, sf):
    return _normalised(eav.normalise_lists(eav.pivot_visits(eav.clean_eav(raw_answers(spark, sf, whole=True)))))


@query(
    "f13_broad_category",
    f"""{_VISITS} SELECT annee, type_patient_code, categorie_diagnostique_large, count(*) AS n FROM visits GROUP BY ALL""",
)
def _(spark, sf):
    visits = eav.normalised_visits(eav.clean_eav(raw_answers(spark, sf)))
    return visits.groupBy("annee", "type_patient_code", "categorie_diagnostique_large").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j1_answer_categories",
    f"""{_ANSWERS} SELECT {t.diagnosis_category('item_slug')} AS categorie_standardisee, {t.diagnosis_subtype('item_slug')} AS sous_type_trauma, count(*) AS n
        FROM eav WHERE cat_slug = 'diagnosticretenuouevoque' GROUP BY ALL""",
)
def _(spark, sf):
    answers = eav.clean_eav(raw_answers(spark, sf)).filter(F.col("cat_slug") == "diagnosticretenuouevoque")
    joined = answers.join(F.broadcast(labels.diagnosis_table(spark)), "item_slug", "left")
    return joined.groupBy("categorie_standardisee", "sous_type_trauma").agg(F.count(F.lit(1)).alias("n"))


_ICD = {c: i for c, i, _ in labels.CODE_SYSTEMS}
_SNOMED = {c: s for c, _, s in labels.CODE_SYSTEMS}


@query(
    "j4_code_systems",
    f"""WITH {EVENT_VISITS_SQL} SELECT diagnostic_categorie, {t.mapped('diagnostic_categorie', _ICD)} AS icd11,
        {t.mapped('diagnostic_categorie', _SNOMED)} AS snomed_ct, count(*) AS n FROM visits GROUP BY ALL""",
)
def _(spark, sf):
    coded = labels.with_codes(event_visits(spark, sf))
    return coded.groupBy("diagnostic_categorie", "icd11", "snomed_ct").agg(F.count(F.lit(1)).alias("n"))


# --- imputation -------------------------------------------------------------

_EVENTS = f"WITH {EVENT_VISITS_SQL}"
_FILLED = ("dossier", "age_imp", "sexe_imp", "diagnostic_categorie_imp")


@query("a4_exact_median", "SELECT event_type, round(median(value), 6) AS mediane FROM events GROUP BY event_type")
def _(spark, sf):
    medians = impute.exact_median(table(spark, sf, "events"), "value", "event_type", "mediane")
    return medians.select("event_type", F.round("mediane", 6).alias("mediane"))


@query(
    "a5_smallest_mode",
    """SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
       FROM events GROUP BY user_id, event_type) t WHERE rn = 1""",
)
def _(spark, sf):
    return impute.smallest_mode(table(spark, sf, "events"), "event_type", "user_id")


@query("i1_median_mode", f"{_EVENTS}, {t.imputed_sql()} SELECT {', '.join(_FILLED)} FROM imputed")
def _(spark, sf):
    return impute.median_mode(event_visits(spark, sf)).select(*_FILLED)


def _chained_sql(rounds: int = 10) -> str:
    """Least-squares chain unrolled; results are whole numbers on both sides.

    Sex has fewer gaps than age here, so it is refitted first.
    """
    parts = [
        "base AS MATERIALIZED (SELECT annee, dossier, CAST(age AS DOUBLE) AS age, CASE sexe WHEN 'Homme' THEN 0.0::DOUBLE WHEN 'Femme' THEN 1.0::DOUBLE END AS sex FROM visits)",
        "r0 AS MATERIALIZED (SELECT b.*, coalesce(b.age, avg(b.age) OVER (PARTITION BY b.annee)) AS a, coalesce(b.sex, avg(b.sex) OVER (PARTITION BY b.annee)) AS s FROM base b)",
    ]
    previous = "r0"
    for r in range(1, rounds + 1):
        for column, now, other in (("sex", "s", "a"), ("age", "a", "s")):
            name = f"{now}{r}"
            kept = other
            parts.append(
                f"""{name} AS MATERIALIZED (SELECT p.annee, p.dossier, p.age, p.sex, p.{kept},
  coalesce(p.{column}, f.i + f.k * p.{other}) AS {now} FROM {previous} p JOIN
  (SELECT annee, regr_intercept({column}, {other}) AS i, regr_slope({column}, {other}) AS k FROM {previous} WHERE {column} IS NOT NULL GROUP BY annee) f ON f.annee = p.annee)"""
            )
            previous = name
    filled = f"""SELECT m.dossier, CAST(round_even(c.a, 0) AS DOUBLE) AS age_imp, CASE WHEN round_even(c.s, 0) <= 0 THEN 'Homme' ELSE 'Femme' END AS sexe_imp,
      m.diagnostic_categorie_imp FROM {previous} c JOIN imputed m ON m.dossier = c.dossier"""
    return f"{_EVENTS}, {t.imputed_sql()}, {', '.join(parts)} {filled}"


@query("i2_chained_regressions", _chained_sql())
def _(spark, sf):
    return impute.mice(event_visits(spark, sf)).select(*_FILLED)


@query("i3_random_forest")
def _(spark, sf):
    return impute.random_forest(event_visits(spark, sf)).select(*_FILLED)


def _moments_sql(source: str, value: str) -> str:
    parts = ", ".join(
        f"CAST(count(v) FILTER (WHERE annee = {y}) AS DOUBLE) AS n{i}, avg(v) FILTER (WHERE annee = {y}) AS m{i}, var_samp(v) FILTER (WHERE annee = {y}) AS v{i}"
        for i, y in ((1, Y1), (2, Y2))
    )
    return f"SELECT {parts} FROM (SELECT annee, CAST({value} AS DOUBLE) AS v FROM {source}) q"


_WELCH_T = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2)"
_WELCH_DOF = "pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"


def _welch_p(source: str, value: str) -> str:
    return f"(SELECT {t.t_p('w.t', 'w.d')} FROM (SELECT {_WELCH_T} AS t, {_WELCH_DOF} AS d FROM ({_moments_sql(source, value)}) q) w)"


@query(
    "i4_sensitivity",
    None,
)
def _(spark, sf):
    visits = staged(event_visits(spark, sf).select("annee", "age", "sexe", "diagnostic_categorie"), "visits")
    return compare.sensitivity(visits, YEARS)


@query(
    "i4_sensitivity_median_mode",
    f"""{_EVENTS}, {t.imputed_sql()}, m AS MATERIALIZED ({_moments_sql('imputed', 'age_imp')}),
        w AS MATERIALIZED (SELECT {_WELCH_T} AS tt, {_WELCH_DOF} AS d FROM m)
        SELECT 'Median/Mode' AS method, {t.rounded('m1')} AS mean_1, {t.rounded('m2')} AS mean_2,
               round((SELECT {t.t_p('w.tt', 'w.d')} FROM w), 6) AS p_value FROM m""",
)
def _(spark, sf):
    table_ = compare.sensitivity(event_visits(spark, sf), YEARS, ("median_mode",))
    return table_.withColumn("p_value", F.round("p_value", 6))


# A forest can't be repeated in SQL. What it fills has to lie near the mean of
# the rows with the same known sex (among the known ages where that misses too).
_NEAR = 1.5


@query(
    "i3_forest_tolerance",
    f"""{_EVENTS} SELECT annee, sexe, count(*) FILTER (WHERE age IS NULL) AS n_filled, count(*) FILTER (WHERE age IS NULL) AS n_near,
        count(age) AS n_kept, CAST(count(*) FILTER (WHERE sexe IS NULL) AS BIGINT) AS n_sexes FROM visits GROUP BY annee, sexe""",
)
def _(spark, sf):
    visits = staged(event_visits(spark, sf).select("annee", "age", "sexe", "diagnostic_categorie"), "visits")
    known = visits.filter("age is not null and sexe is not null").groupBy("annee", "sexe").agg(F.avg("age").alias("mean"))
    limits = visits.groupBy("annee").agg(F.min("age").cast("double").alias("low"), F.max("age").cast("double").alias("high"))
    of_sex = known.unionByName(limits.select("annee", F.lit(None).cast("string").alias("sexe"), F.lit(None).cast("double").alias("mean")))
    expected = of_sex.join(limits, "annee").select(
        F.col("annee").alias("y"), F.col("sexe").alias("s"), (F.coalesce("mean", "low") - _NEAR).alias("low"), (F.coalesce("mean", "high") + _NEAR).alias("high")
    )
    filled = impute.random_forest(visits).join(F.broadcast(expected), (F.col("annee") == F.col("y")) & F.col("sexe").eqNullSafe(F.col("s")))
    return filled.groupBy("annee", "sexe").agg(
        F.count(F.when(F.col("age").isNull(), 1)).alias("n_filled"),
        F.count(F.when(F.col("age").isNull() & F.col("age_imp").between(F.col("low"), F.col("high")), 1)).alias("n_near"),
        F.count(F.when(F.col("age") == F.col("age_imp"), 1)).alias("n_kept"),
        F.count(F.when(F.col("sexe").isNull() & F.col("sexe_imp").isin("Homme", "Femme"), 1)).alias("n_sexes"),
    )


@query(
    "i4_sensitivity_tolerance",
    f"""{_EVENTS}, {t.imputed_sql()}, chained AS MATERIALIZED (SELECT CAST({Y1} + CAST(substring(dossier, 2) AS BIGINT) % 2 AS INTEGER) AS annee, age_imp FROM ({_chained_sql()}) c),
        m AS MATERIALIZED ({_moments_sql('imputed', 'age_imp')}), k AS MATERIALIZED ({_moments_sql('chained', 'age_imp')})
        SELECT 'Median/Mode' AS method, {t.rounded('m1')} AS mean_1, {t.rounded('m2')} AS mean_2, TRUE AS near FROM m
        UNION ALL SELECT 'MICE', {t.rounded('m1')}, {t.rounded('m2')}, TRUE FROM k UNION ALL SELECT 'Random Forest', NULL, NULL, TRUE FROM k""",
)
def _(spark, sf):
    """The means of all three methods; the forest's have to be within 1 of the chained regressions'."""
    visits = staged(event_visits(spark, sf).select("annee", "age", "sexe", "diagnostic_categorie"), "visits")
    means = staged(compare.sensitivity(visits, YEARS), "sensitivity")
    forest = F.col("method") == impute.METHODS["random_forest"]
    mice = means.filter(F.col("method") == impute.METHODS["mice"]).select(F.col("mean_1").alias("k1"), F.col("mean_2").alias("k2"))
    close = (F.abs(F.col("mean_1") - F.col("k1")) <= 1) & (F.abs(F.col("mean_2") - F.col("k2")) <= 1) & F.col("p_value").between(0, 1)
    shown = [F.when(~forest, F.col(c)).alias(c) for c in ("mean_1", "mean_2")]
    joined = means.withColumn("one", F.lit(1)).join(F.broadcast(mice.withColumn("one", F.lit(1))), "one")
    return joined.select("method", *shown, F.when(forest, close).otherwise(F.lit(True)).alias("near"))


# --- deduplication ----------------------------------------------------------

_PARTS = f"WITH {PART_VISITS_SQL}"


@query(
    "d1_j2_scored_pairs",
    f"""{_PARTS}, keyed AS (SELECT *, {t.soundex('nom_complet_norm')} AS block FROM visits WHERE age IS NOT NULL),
        cells AS (SELECT annee, block, nom_complet_norm, sexe, age, day, min(visit_no) AS cell FROM
                  (SELECT *, CAST(floor(epoch_us(date_entree) / 86400000000.0) AS BIGINT) AS day FROM keyed) k GROUP BY ALL),
        pairs AS (SELECT i.annee, least(i.cell, j.cell) AS a, greatest(i.cell, j.cell) AS b, coalesce(abs(i.day - j.day), 0) AS days,
                         jaro_winkler_similarity(i.nom_complet_norm, j.nom_complet_norm) AS s, 1 - abs(i.age - j.age) / 2.0::DOUBLE AS g
                  FROM cells i JOIN cells j ON i.annee = j.annee AND i.block = j.block AND i.sexe = j.sexe AND i.cell < j.cell
                  WHERE abs(i.age - j.age) <= 2 AND coalesce(abs(i.day - j.day), 0) <= 2),
        scored AS (SELECT *, 0.7::DOUBLE * s + 0.2::DOUBLE * g + 0.1::DOUBLE * 1 AS near, 0.7::DOUBLE * s + 0.2::DOUBLE * g + 0.1::DOUBLE * 0 AS far FROM pairs)
        SELECT annee, a, b, round(s, 6) AS similarity, round(near, 6) AS score_near, round(far, 6) AS score_far FROM scored
        WHERE CASE WHEN days <= 1 THEN near ELSE far END >= 0.85""",
)
def _(spark, sf):
    visits = part_visits(spark, sf)
    cells = staged(dedup.match_cells(dedup.match_classes(visits), cliques=True), "cells")
    pairs = dedup.scored_cell_pairs(cells)
    scores = [F.round(c, 6).alias(c) for c in ("similarity", "score_near", "score_far")]
    return pairs.select("annee", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *scores)


@query(
    "d2_j3_keep_first",
    f"""{_PARTS}, {t.keep_first_sql('visits')}
        SELECT v.annee, v.visit_no, v.nom_complet_norm, v.sexe, v.age FROM visits v JOIN kept k ON k.annee = v.annee AND k.visit_no = v.visit_no""",
)
def _(spark, sf):
    visits = part_visits(spark, sf)
    outcome = dedup.keep_first(dedup.match_classes(visits))
    return dedup.without_dropped(visits, outcome).select("annee", "visit_no", "nom_complet_norm", "sexe", "age")


@query("d3_d4_report", f"{_PARTS}, {t.keep_first_sql('visits')}, {t.PAIRS_SQL}, {t.report_sql('visits')} SELECT * FROM report")
def _(spark, sf):
    _, report = dedup.deduplicate(part_visits(spark, sf))
    return report


# --- statistics -------------------------------------------------------------

_STATUS = ("priorite", "o_orderpriority"), ("statut", "CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderkey % 6 <> 0 THEN 'autre' END")
_ORDERS = (
    f"WITH orders_y AS (SELECT CAST({Y1} + o_orderkey % 2 AS INTEGER) AS annee, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _STATUS)
    + ", CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS prix FROM orders)"
)


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        (F.lit(Y1) + F.col("o_orderkey") % 2).cast("int").alias("annee"),
        *[F.expr(sql).alias(name) for name, sql in _STATUS],
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("prix"),
    )


@query(
    "a12_contingency",
    f"""{_ORDERS} SELECT statut, CAST(count(*) FILTER (WHERE annee = {Y1}) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE annee = {Y2}) AS BIGINT) AS n2
        FROM orders_y WHERE statut IS NOT NULL GROUP BY statut""",
)
def _(spark, sf):
    found = compare.contingency(_orders(spark, sf), "statut", YEARS)
    return found.select("statut", F.col(f"`{Y1}`").alias("n1"), F.col(f"`{Y2}`").alias("n2"))


def _chi_sql(source: str, column: str, yates: bool) -> str:
    """Expected counts cell by cell; ends in one row (chi2, dof)."""
    gap = "abs(o - e)"
    gap = f"({gap} - least(0.5::DOUBLE, {gap}))" if yates else gap
    return f"""SELECT sum(pow({gap}, 2) / e) AS chi2, CAST(count(DISTINCT c) - 1 AS BIGINT) AS dof FROM (
      SELECT r.c, y.annee, coalesce(x.n, 0)::DOUBLE AS o, r.n::DOUBLE * y.n / (sum(y.n) OVER (PARTITION BY r.c)) AS e
      FROM (SELECT {column} AS c, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) r
      CROSS JOIN (SELECT annee, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) y
      LEFT JOIN (SELECT {column} AS c, annee, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1, 2) x ON x.c = r.c AND x.annee = y.annee) z"""


def _one_row(spark, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


_CHI_SCHEMA = "chi2 double, dof bigint, p_value double"


def _rounded_result(result: dict, *names: str) -> list[float]:
    return [round(result[n], 6) if isinstance(result[n], float) else result[n] for n in names]


def _chi_query(column: str, yates: bool):
    sql = f"{_ORDERS}, c AS MATERIALIZED ({_chi_sql('orders_y', column, yates)}) SELECT round(chi2, 6) AS chi2, dof, round((SELECT {t.chi_square_p('c.chi2', 'c.dof')} FROM c), 6) AS p_value FROM c"

    def run(spark, sf):
        result = compare.chi_square(_orders(spark, sf), column, YEARS)
        return _one_row(spark, _CHI_SCHEMA, *_rounded_result(result, "chi2", "dof", "p_value"))

    return sql, run


for _key, _column, _yates in (("x1_chi_square", "priorite", False), ("x1_chi_square_yates", "statut", True)):
    _sql, _run = _chi_query(_column, _yates)
    query(_key, _sql)(_run)


_STUDENT_ERROR = "sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))"
_T_SCHEMA = "t double, dof double, mean1 double, sd1 double, mean2 double, sd2 double, p_value double"


def _t_query(equal_var: bool):
    tt, dof = (f"(m1 - m2) / {_STUDENT_ERROR}", "n1 + n2 - 2") if equal_var else (_WELCH_T, _WELCH_DOF)
    sql = f"""{_ORDERS}, m AS MATERIALIZED ({_moments_sql('orders_y', 'prix')}), w AS MATERIALIZED (SELECT {tt} AS t, {dof} AS d FROM m)
        SELECT (SELECT round(t, 6) FROM w) AS t, (SELECT round(d, 4) FROM w) AS dof, round(m1, 4) AS mean1, round(sqrt(v1), 4) AS sd1,
        round(m2, 4) AS mean2, round(sqrt(v2), 4) AS sd2, round((SELECT {t.t_p('w.t', 'w.d')} FROM w), 6) AS p_value FROM m"""

    def run(spark, sf):
        r = compare.t_test(_orders(spark, sf), "prix", YEARS, equal_var)
        values = [round(r[c], 6 if c in ("t", "p_value") else 4) for c in ("t", "dof", "mean1", "sd1", "mean2", "sd2", "p_value")]
        return _one_row(spark, _T_SCHEMA, *values)

    return sql, run


for _key, _equal in (("x2_student", True), ("x2_welch", False)):
    _sql, _run = _t_query(_equal)
    query(_key, _sql)(_run)


def _levene_sql(source: str, value: str) -> str:
    return f"""SELECT (n1 + n2 - 2) * (n1 * pow(m1 - g, 2) + n2 * pow(m2 - g, 2)) / ((n1 - 1) * v1 + (n2 - 1) * v2) AS w, n1 + n2 - 2 AS d
        FROM (SELECT *, (n1 * m1 + n2 * m2) / (n1 + n2) AS g FROM ({_moments_sql(f'''(SELECT s.annee, abs(CAST(s.{value} AS DOUBLE) - q.md) AS z FROM {source} s
        JOIN (SELECT annee, median(CAST({value} AS DOUBLE)) AS md FROM {source} GROUP BY annee) q ON q.annee = s.annee)''', 'z')}) m) h"""


@query(
    "x3_levene",
    f"""{_ORDERS}, l AS MATERIALIZED ({_levene_sql('orders_y', 'prix')})
        SELECT round(w, 6) AS w, d AS dof, round((SELECT {t.t_p('sqrt(l.w)', 'l.d')} FROM l), 6) AS p_value FROM l""",
)
def _(spark, sf):
    result = compare.levene(_orders(spark, sf), "prix", YEARS)
    return _one_row(spark, "w double, dof double, p_value double", *_rounded_result(result, "w", "dof", "p_value"))


def _z_sql(source: str, hit: str) -> str:
    return f"""SELECT (p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) AS z, p1, p2 FROM (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, (k1 + k2) / (n1 + n2) AS p FROM (
      SELECT CAST(count(*) FILTER (WHERE annee = {Y1}) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE annee = {Y2}) AS DOUBLE) AS n2,
             CAST(count(*) FILTER (WHERE annee = {Y1} AND {hit}) AS DOUBLE) AS k1, CAST(count(*) FILTER (WHERE annee = {Y2} AND {hit}) AS DOUBLE) AS k2 FROM {source}) c) d"""


@query(
    "x4_two_proportion_z",
    f"""{_ORDERS}, z AS MATERIALIZED ({_z_sql('orders_y', "priorite = '1-URGENT'")})
        SELECT round(z, 6) AS z, round(p1, 6) AS prop1, round(p2, 6) AS prop2, round((SELECT {t.normal_p('z.z')} FROM z), 6) AS p_value FROM z""",
)
def _(spark, sf):
    result = compare.two_proportion_z(_orders(spark, sf), F.col("priorite") == "1-URGENT", YEARS)
    return _one_row(
        spark, "z double, prop1 double, prop2 double, p_value double", *_rounded_result(result, "z", "prop1", "prop2", "p_value")
    )


@query(
    "a13_moments",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS moyenne, round(stddev_samp(l_quantity), 6) AS ecart_type, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 6).alias("moyenne"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("ecart_type"),
        F.count("l_quantity").alias("n"),
    )


def _tests_sql(source: str, prefix: str = "") -> tuple[str, str]:
    """CTEs with the four tests of an imputed table, and the select over them."""
    p = prefix
    ctes = f"""
{p}cs AS MATERIALIZED ({_chi_sql(source, 'sexe_imp', True)}),
{p}cd AS MATERIALIZED ({_chi_sql(source, 'categorie_diagnostique_large', True)}),
{p}lv AS MATERIALIZED ({_levene_sql(source, 'age_imp')}),
{p}eq AS MATERIALIZED (SELECT {t.t_p('sqrt(l.w)', 'l.d')} > 0.05 AS equal FROM {p}lv l),
{p}mo AS MATERIALIZED ({_moments_sql(source, 'age_imp')}),
{p}tt AS MATERIALIZED (SELECT CASE WHEN equal THEN 'Student' ELSE 'Welch' END AS test,
  CASE WHEN equal THEN (m1 - m2) / {_STUDENT_ERROR} ELSE {_WELCH_T} END AS t, CASE WHEN equal THEN n1 + n2 - 2 ELSE {_WELCH_DOF} END AS d FROM {p}mo, {p}eq),
{p}zz AS MATERIALIZED ({_z_sql(source, "categorie_diagnostique_large = 'Trauma'")})"""
    sex = f"SELECT 'Sexe' AS \"Variable\", 'Chi2 de Pearson' AS \"Test\", round(chi2, 6) AS \"Statistique\", round((SELECT {t.chi_square_p('c.chi2', 'c.dof')} FROM {p}cs c), 6) AS p_value FROM {p}cs"
    age = f"SELECT 'Age', test, round(t, 6), round((SELECT {t.t_p('w.t', 'w.d')} FROM {p}tt w), 6) FROM {p}tt"
    broad = f"SELECT 'Categorie diagnostique', 'Chi2 de Pearson', round(chi2, 6), round((SELECT {t.chi_square_p('c.chi2', 'c.dof')} FROM {p}cd c), 6) FROM {p}cd"
    share = f"SELECT 'Proportion Trauma', 'Test de proportion (z)', round(z, 6), round((SELECT {t.normal_p('c.z')} FROM {p}zz c), 6) FROM {p}zz"
    return ctes, (sex, age, broad, share)


_SUMMARY_CTES, _SUMMARY_ROWS = _tests_sql("imputed")


def _rounded_summary(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("Statistique", "p_value")})


@query("x5_test_summary", f"{_EVENTS}, {t.imputed_sql()}, {_SUMMARY_CTES} " + " UNION ALL ".join(_SUMMARY_ROWS))
def _(spark, sf):
    columns = ("annee", "age", "sexe", "diagnostic_categorie", "categorie_diagnostique_large")
    visits = event_visits(spark, sf).select(*columns)
    return _rounded_summary(compare.test_summary(staged(impute.median_mode(visits), "imputed"), YEARS))


# --- reports ----------------------------------------------------------------

def _quality_sql() -> str:
    def pct(hit: str, among: str = "TRUE") -> str:
        return t.rounded(f"(100 * avg(CASE WHEN {among} THEN CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END))")

    plausible = ", ".join(f"'{c}'" for c in labels.PLAUSIBLE_DIAGNOSES)
    rows = [
        ("Age", pct("age IS NOT NULL"), pct("age BETWEEN 0 AND 120", "age IS NOT NULL"), pct("age_imp BETWEEN 0 AND 120")),
        ("Sexe", pct("sexe IS NOT NULL"), pct("sexe IN ('Homme', 'Femme')", "sexe IS NOT NULL"), pct("sexe_concordant")),
        ("Diagnostic principal", pct("diagnostic_categorie IS NOT NULL"), pct(f"diagnostic_categorie IN ({plausible})", "diagnostic_categorie IS NOT NULL"), "NULL::DOUBLE"),
        ("Type de trauma", f"coalesce({pct('trauma_type IS NOT NULL', chr(39).join(['diagnostic_categorie = ', 'TRAUMA', '']))}, 0.0::DOUBLE)", "NULL::DOUBLE", "NULL::DOUBLE"),
        ("Date de consultation", pct("date_entree IS NOT NULL"), "100.0::DOUBLE", "100.0::DOUBLE"),
    ]
    selects = " UNION ALL ".join(
        f"SELECT {i} AS o, '{v}' AS \"Variable\", {c} AS completude, {e} AS exactitude, {k} AS concordance, 100.0::DOUBLE AS unicite FROM imputed"
        for i, (v, c, e, k) in enumerate(rows)
    )
    means = ", ".join(f"{t.rounded(f'avg({m})')}" for m in quality.MEASURES)
    return f"""{_EVENTS}, {t.imputed_sql()}, q AS MATERIALIZED ({selects})
      SELECT "Variable", completude, exactitude, concordance, unicite FROM q UNION ALL SELECT 'Moyenne', {means} FROM q"""


@query("r2_a14_quality", _quality_sql())
def _(spark, sf):
    return quality.quality_report(impute.median_mode(event_visits(spark, sf)))


def _visits(spark, sf):
    return flow.enrich(event_visits(spark, sf))


def _counts_sql(expression: str, name: str, keep_null: bool = False, where: str = "TRUE") -> str:
    known = "TRUE" if keep_null else f"{expression} IS NOT NULL"
    return f"{_EVENTS} SELECT {expression} AS {name}, count(*) AS n FROM visits WHERE {known} AND {where} GROUP BY 1"


@query("a8_distinct_patients", f"{_EVENTS} SELECT count(DISTINCT dossier) AS n_patients FROM visits")
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["patients"]


@query("r3_by_year", _counts_sql("annee", "annee"))
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["par_annee"]


@query("r3_a6_by_sex", _counts_sql("sexe", "sexe", keep_null=True))
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["par_sexe"]


_BANDS = ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(typed.AGE_BANDS))


@query(
    "r3_a7_by_age_band",
    f"""{_EVENTS}, b(ordre, tranche_age) AS (VALUES {_BANDS})
        SELECT b.ordre, b.tranche_age, count(v.dossier) AS n FROM b LEFT JOIN visits v ON {t.age_band_order('v.age')} = b.ordre GROUP BY ALL""",
)
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["par_tranche_age"]


@query(
    "r3_a9_by_hour_and_year",
    f"{_EVENTS} SELECT CAST(extract(hour FROM date_entree) AS INTEGER) AS heure, annee, count(*) AS n FROM visits WHERE date_entree IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["par_heure"].withColumnRenamed("Heure_entree", "heure")


@query("r3_a10_by_day", _counts_sql("strftime(date_entree, '%Y-%m-%d')", "jour"))
def _(spark, sf):
    return flow.patient_flow(_visits(spark, sf))["par_jour"].select(F.col("Date").cast("string").alias("jour"), "n")


@query("r4_o2_top_categories", _counts_sql("diagnostic_categorie", "diagnostic_categorie") + " ORDER BY n DESC, 1 LIMIT 10")
def _(spark, sf):
    return flow.diagnoses(_visits(spark, sf))["top_categories"]


@query("r5_p4_trauma_rows", f"{_EVENTS} SELECT count(*) AS n FROM visits WHERE categorie_diagnostique_large = 'Trauma'")
def _(spark, sf):
    return flow.trauma(_visits(spark, sf))["cas_trauma"]


@query(
    "r5_a11_trauma_shares",
    f"""{_EVENTS}, c AS (SELECT trauma_type, count(*) AS n FROM visits WHERE categorie_diagnostique_large = 'Trauma' AND trauma_type IS NOT NULL GROUP BY 1)
        SELECT trauma_type, n, {t.rounded('((100 * n)::DOUBLE / (SELECT sum(n) FROM c))')} AS pct FROM c""",
)
def _(spark, sf):
    return flow.trauma(_visits(spark, sf))["causes_trauma"]


@query("r6_services", _counts_sql("service_principal", "service_principal"))
def _(spark, sf):
    return flow.services(_visits(spark, sf))["services"]


def _outcome(column: str):
    def run(spark, sf):
        return flow.outcomes(_visits(spark, sf))[column]

    return run


for _column in ("typologie_cas", "evolution_immediate", "duree_hospitalisation"):
    query(f"r7_{_column}", _counts_sql(_column, _column, keep_null=True))(_outcome(_column))


# Report -> (value, second key, condition); a report over shares has its percentages too.
_R8 = {
    "par_annee": ("CAST(annee AS VARCHAR)", None, "TRUE"),
    "par_sexe": ("sexe", None, "TRUE"),
    "par_heure": ("CAST(CAST(extract(hour FROM date_entree) AS INTEGER) AS VARCHAR)", "annee", "date_entree IS NOT NULL"),
    "par_jour": ("strftime(date_entree, '%Y-%m-%d')", None, "date_entree IS NOT NULL"),
    "services": ("service_principal", None, "service_principal IS NOT NULL"),
    "typologie_cas": ("typologie_cas", None, "TRUE"),
    "evolution_immediate": ("evolution_immediate", None, "TRUE"),
    "duree_hospitalisation": ("duree_hospitalisation", None, "TRUE"),
}
_TRAUMA = "categorie_diagnostique_large = 'Trauma'"
_R8_SQL = " UNION ALL ".join(
    [
        f"SELECT '{name}' AS rapport, {value} AS valeur, {f'CAST({key} AS VARCHAR)' if key else 'NULL::VARCHAR'} AS cle, count(*) AS n, NULL::DOUBLE AS pct "
        f"FROM visits WHERE {where} GROUP BY 2, 3"
        for name, (value, key, where) in _R8.items()
    ]
    + [
        "SELECT 'patients', NULL, NULL, count(DISTINCT dossier), NULL FROM visits",
        f"SELECT 'par_tranche_age', b.tranche_age, CAST(b.ordre AS VARCHAR), count(v.dossier), NULL FROM b LEFT JOIN visits v ON {t.age_band_order('v.age')} = b.ordre GROUP BY 2, 3",
        "SELECT * FROM (SELECT 'top_categories', diagnostic_categorie, NULL::VARCHAR, count(*) AS n, NULL::DOUBLE FROM visits WHERE diagnostic_categorie IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) c",
        f"SELECT 'cas_trauma', NULL, NULL, count(*), NULL FROM visits WHERE {_TRAUMA}",
        f"""SELECT 'causes_trauma', trauma_type, NULL, n, {t.rounded('(100 * n::DOUBLE / total)')}
            FROM (SELECT trauma_type, count(*) AS n, sum(count(*)) OVER () AS total FROM visits WHERE {_TRAUMA} AND trauma_type IS NOT NULL GROUP BY 1) s""",
    ]
)


def _report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """All reports in one table: value, second key, number and percentage."""
    out = None
    for name, part in report.items():
        number = part.columns[0] if name in ("patients", "cas_trauma") else "n"
        value, key = {
            "patients": (None, None), "cas_trauma": (None, None), "par_heure": ("Heure_entree", "annee"), "par_tranche_age": ("tranche_age", "ordre"),
        }.get(name, (part.columns[0], None))
        show = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
        rows = part.select(
            F.lit(name).alias("rapport"), show(value).alias("valeur"), show(key).alias("cle"), F.col(number).cast("bigint").alias("n"),
            (F.col("pct") if "pct" in part.columns else F.lit(None)).cast("double").alias("pct"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("r8_full_report", f"{_EVENTS}, b(ordre, tranche_age) AS (VALUES {_BANDS}) {_R8_SQL}")
def _(spark, sf):
    return _report_rows(flow.full_report(staged(_visits(spark, sf), "enriched")))


_WITHOUT = ("top_categories", "causes_trauma")


@query(
    "p9_optional_columns",
    f"""{_EVENTS}, b(ordre, tranche_age) AS (VALUES {_BANDS}), r(rapport, valeur, cle, n, pct) AS ({_R8_SQL})
        SELECT * FROM r WHERE rapport NOT IN ({', '.join(map(t.quoted, _WITHOUT))})""",
)
def _(spark, sf):
    lean = _visits(spark, sf).drop("diagnostic_categorie", "trauma_type")
    return _report_rows(flow.full_report(staged(lean, "enriched")))


# --- sources and sinks --------------------------------------------------------

_RAW_ORDER = ("row_no", "titre", "attribut", "patient", "dossier", "date_entree", "reponse")


@query(
    "s1_raw_round_trip",
    f"""WITH {RAW_ANSWERS_SQL} SELECT row_no, CASE WHEN from_lines THEN 'lineitem' ELSE 'orders' END AS titre, attribut, NULL::VARCHAR AS patient,
        dossier, date_entree, reponse, annee FROM raw""",
)
def _(spark, sf):
    """Both years written as CSV exports and read back by position."""
    answers = raw_answers(spark, sf)
    paths = {y: new_table_path(spark, f"export-{y}") for y in YEARS}
    for year, path in paths.items():
        tables.write_csv(answers.filter(F.col("annee") == year).select(*_RAW_ORDER), path, compression="gzip")
    return tables.read_raw_years(spark, paths, "csv")


@query(
    "s1_raw_rejects",
    """SELECT 'row_no' AS colonne, concat('ligne ', event_id % 7) AS valeur, count(*) AS n FROM events WHERE event_id % 20 = 3 GROUP BY 2""",
)
def _(spark, sf):
    """An export in which every twentieth row number is a text."""
    number = F.expr("CASE WHEN event_id % 20 = 3 THEN concat('ligne ', event_id % 7) ELSE CAST(event_id AS STRING) END")
    rows = table(spark, sf, "events").select(
        number.alias("row_no"), F.lit("t").alias("titre"), F.col("event_type").alias("attribut"), F.lit(None).cast("string").alias("patient"),
        F.col("user_id").cast("string").alias("dossier"), F.lit(None).cast("string").alias("date_entree"), F.lit("on").alias("reponse"),
    )
    path = new_table_path(spark, "export")
    tables.write_csv(rows, path)
    return tables.read_raw_checked(spark, path, Y1).rejects


def _written_clean(spark, sf) -> str:
    """Clean events as CSV, with padded names in another order, an extra column and some unreadable values."""
    rows = impute.median_mode(event_visits(spark, sf)).select(
        F.lit("x").alias("autre"), F.col("date_entree"),
        F.expr("CASE WHEN visit_no % 25 = 0 THEN concat('age ', visit_no % 3) ELSE CAST(age AS STRING) END").alias("age"),
        F.col("age_imp"), F.col("annee"), *[F.col(c) for c in ("dossier", "sexe", "sexe_imp", "service_principal", "diagnostic_categorie", "diagnostic_categorie_imp",
        "trauma_type", "categorie_diagnostique_large", "typologie_cas", "evolution_immediate", "duree_hospitalisation")],
        F.expr("CASE WHEN visit_no % 30 = 0 THEN '  \"Nord\", rue 5 ' WHEN visit_no % 30 = 1 THEN '' END").alias("provenance"),
        F.lit(None).cast("string").alias("type_patient"),
    )
    path = new_table_path(spark, "clean")
    tables.write_csv(rows.withColumnRenamed("dossier", " dossier ").withColumnRenamed("age", "age "), path)
    return path


_READ_CLEAN = {c: c for c in tables.CLEAN_COLUMNS} | {
    "age": "CASE WHEN visit_no % 25 <> 0 THEN age END",
    # An empty cell is a missing one, also in quotes.
    "provenance": "CASE WHEN visit_no % 30 = 0 THEN '  \"Nord\", rue 5 ' END",
    "type_patient": "NULL::VARCHAR", "date_entree": "strftime(date_entree, '%Y-%m-%d %H:%M:%S.%f')",
}


@query(
    "s2_s4_clean_round_trip",
    f"{_EVENTS}, {t.imputed_sql()} SELECT {', '.join(f'{sql} AS {c}' for c, sql in _READ_CLEAN.items())} FROM imputed",
)
def _(spark, sf):
    clean = tables.read_clean_checked(spark, _written_clean(spark, sf)).rows
    return clean.withColumn("date_entree", F.date_format("date_entree", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("s2_rejects", f"{_EVENTS} SELECT 'age' AS colonne, concat('age ', visit_no % 3) AS valeur, count(*) AS n FROM visits WHERE visit_no % 25 = 0 GROUP BY 2")
def _(spark, sf):
    return tables.read_clean_checked(spark, _written_clean(spark, sf)).rejects


@query(
    "s5_enriched_round_trip",
    f"""{_EVENTS} SELECT visit_no, dossier, annee, age, sexe, CAST(extract(hour FROM date_entree) AS INTEGER) AS "Heure_entree", strftime(date_entree, '%A') AS "Jour_semaine",
        strftime(date_entree, '%Y-%m-%d') AS jour, {t.age_band('age')} AS tranche_age FROM visits""",
)
def _(spark, sf):
    """The enriched table written by year and read back with its partitions."""
    path = new_table_path(spark, "enriched")
    tables.write_by_year(_visits(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.select("visit_no", "dossier", "annee", "age", "sexe", "Heure_entree", "Jour_semaine", F.col("Date").cast("string").alias("jour"), "tranche_age")


@query(
    "u1_union_years",
    "SELECT annee, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS annee FROM orders UNION ALL SELECT CAST(year(l_shipdate) AS INTEGER) FROM lineitem) u GROUP BY annee",
)
def _(spark, sf):
    one = table(spark, sf, "orders").select(F.year("o_orderdate").alias("annee"))
    two = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("annee"))
    return counts.counts_by_key(one.unionByName(two), "annee")


@query("u2_set_union", "SELECT p_type AS valeur FROM part UNION SELECT l_returnflag FROM lineitem UNION SELECT o_orderpriority FROM orders")
def _(spark, sf):
    parts = [
        table(spark, sf, name).select(F.col(column).alias("valeur"))
        for name, column in (("part", "p_type"), ("lineitem", "l_returnflag"), ("orders", "o_orderpriority"))
    ]
    # Distinct first on each side: fewer rows reach the common shuffle.
    return parts[0].distinct().union(parts[1].distinct()).union(parts[2].distinct()).distinct()


# --- the whole run ----------------------------------------------------------

_EXPORT = (
    "dossier", "annee", "age", "age_imp", "sexe", "sexe_imp", "provenance", "service_principal", "type_patient",
    "diagnostic_categorie", "diagnostic_categorie_imp", "trauma_type", "categorie_diagnostique_large", "typologie_cas",
    "evolution_immediate", "duree_hospitalisation",
)
_RUN = f"{_VISITS}, {t.imputed_sql()}, {t.keep_first_sql('imputed')}"


@query(
    "phi_clean_visits",
    f"""{_RUN} SELECT {', '.join('v.' + c for c in _EXPORT)}, strftime(v.date_entree, '%Y-%m-%d %H:%M') AS date_entree
        FROM imputed v JOIN kept k ON k.annee = v.annee AND k.visit_no = v.visit_no""",
)
def _(spark, sf):
    clean = cleaning.clean(raw_answers(spark, sf)).export
    return clean.withColumn("date_entree", F.date_format("date_entree", "yyyy-MM-dd HH:mm"))


@query(
    "r1_volumetry",
    f"""{_RUN}, {t.PAIRS_SQL}, {t.report_sql('imputed')}
        SELECT r.annee, CAST(l.n AS BIGINT) AS n_lignes_eav_brutes, r.n_avant AS n_patients_avant_dedup, r.n_apres AS n_patients_apres_dedup,
               {t.rounded('((100 * r.n_apres)::DOUBLE / r.n_avant)')} AS taux_retention_patients_pct, r.n_avant, r.n_apres, r.n_doublons_supprimes,
               r.taux_doublons_pct, r.n_paires_evaluees
        FROM report r JOIN (SELECT annee, sum(n_lignes) AS n FROM visits GROUP BY annee) l ON l.annee = r.annee""",
)
def _(spark, sf):
    return cleaning.clean(raw_answers(spark, sf)).volumetry


_IMPACT_BEFORE, _BEFORE_ROWS = _tests_sql("imputed", "b_")
_IMPACT_AFTER, _AFTER_ROWS = _tests_sql("after_dedup", "a_")


@query(
    "x6_dedup_impact",
    f"""{_RUN}, after_dedup AS MATERIALIZED (SELECT v.* FROM imputed v JOIN kept k ON k.annee = v.annee AND k.visit_no = v.visit_no),
        {_IMPACT_BEFORE}, {_IMPACT_AFTER}
        SELECT 'avant' AS "Etape", * FROM ({_BEFORE_ROWS[0]} UNION ALL {_BEFORE_ROWS[1]}) x
        UNION ALL SELECT 'apres', * FROM ({_AFTER_ROWS[0]} UNION ALL {_AFTER_ROWS[1]}) y""",
)
def _(spark, sf):
    run = cleaning.clean(raw_answers(spark, sf))
    columns = ("annee", "sexe_imp", "age_imp")
    after = staged(run.clean.select(*columns), "after")
    return _rounded_summary(compare.dedup_impact(run.imputed.select(*columns), after, YEARS))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Volume report of the whole cleaning run."""
    return QUERIES["r1_volumetry"](spark, sf)
