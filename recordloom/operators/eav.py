"""Raw answers to visits: cleaning, pivot with answer lists, normalised visits.

Two shapes come out of the same answers. ``pivot_visits`` keeps every ticked
answer in an ordered list per visit. ``normalised_visits`` takes the clean
answers straight to the scalar columns the later stages need, with aggregates
whose state per visit has a fixed size: rows are combined before the shuffle,
so a visit holding a large part of all answers costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text, typed
from ..session import few_rows_or_none, keep_lists_hashed, keep_methods_compilable

# Category key -> list column. Keys of one column are merged in
# this order.
LIST_COLUMNS = {
    "sexe": "sexe_brut",
    "trancheage": "tranche_age",
    "trancheda": "tranche_age",
    "trancheddge": "tranche_age",
    "provenance": "provenance",
    "service": "service",
    "motifdeconsultation": "motif_consultation",
    "antecedentspathologiques": "antecedents",
    "diagnosticretenuouevoque": "diagnostic",
    "conduitetenir": "conduite_a_tenir",
    "explorationsbiologiques": "explorations_biologiques",
    "explorationsradiologiques": "explorations_radiologiques",
    "hospitalisationevacuation": "hospitalisation_evacuation",
    "typedetraitement": "type_traitement",
    "dureeapproximativedhospitalisation": "duree_hospitalisation",
    "evolutionimmediatedansles24h": "evolution_immediate",
    "typologieducas": "typologie_cas",
}
# Keys that well-formed labels produce and the table above misses; opt in with
# ``{**LIST_COLUMNS, **EXTRA_KEYS}``.
EXTRA_KEYS = {"tranchedage": "tranche_age", "conduiteatenir": "conduite_a_tenir"}

# Fixed value: category key of the identity questions.
IDENTITY = "identifiant"
# List column -> scalar column holding its first answer.
FIRST_ANSWERS = {
    "provenance": "provenance",
    "service": "service_principal",
    "tranche_age": "tranche_age_declaree",
    "typologie_cas": "typologie_cas",
    "evolution_immediate": "evolution_immediate",
    "duree_hospitalisation": "duree_hospitalisation",
}
# Lists that ``normalise_lists`` reads.
READ_LISTS = ("sexe_brut", "diagnostic", *FIRST_ANSWERS)
VISIT = ("annee", "dossier")


def _attribute_keys(attribute: Column, repair: bool) -> dict[str, Column]:
    """Clean attribute, its two parts and their keys, from the raw attribute."""
    cleaned = text.clean_text(attribute, repair)
    category, item = text.attribute_category(cleaned), text.attribute_item(cleaned)
    return {
        "attribut": cleaned,
        "categorie": category,
        "item": item,
        "cat_slug": text.slug(category),
        "item_slug": text.slug(item),
    }


def _with_attribute_keys(df: DataFrame, repair: bool) -> DataFrame:
    """Clean attribute, its two parts and their keys."""
    cleaned = df.withColumn("attribut", text.clean_text(F.col("attribut"), repair))
    parts = cleaned.withColumns(
        {
            "categorie": text.attribute_category(F.col("attribut")),
            "item": text.attribute_item(F.col("attribut")),
        }
    )
    return parts.withColumns(
        {"cat_slug": text.slug(F.col("categorie")), "item_slug": text.slug(F.col("item"))}
    )


def clean_eav(raw: DataFrame, repair: bool = True) -> DataFrame:
    """Clean the text cells, drop rows without a dossier, derive the keys.

    A form has few attributes and they repeat in every visit, so the distinct
    ones are cleaned once and joined back as a broadcast table. If there are
    too many to broadcast, the same expressions run on every row instead.
    """
    keep_methods_compilable(raw.sparkSession)
    cells = raw.withColumns(
        {c: text.clean_text(F.col(c), repair) for c in ("patient", "dossier", "reponse")}
    ).filter(F.col("dossier").isNotNull())
    cells = cells.withColumn("reponse_on", text.is_ticked(F.col("reponse")))
    distinct = few_rows_or_none(raw.select("attribut").distinct())
    if distinct is None:
        return _with_attribute_keys(cells, repair)
    return _with_known_keys(cells, distinct, repair)


def _with_known_keys(cells: DataFrame, distinct: list, repair: bool) -> DataFrame:
    """Keys looked up in a broadcast table of the attributes seen when planning.

    A row whose attribute is not among them (the table grew meanwhile) keeps
    its place: its keys are computed from the row itself.
    """
    spark = cells.sparkSession
    seen = spark.createDataFrame(distinct, "attribut string")
    known = _with_attribute_keys(seen.withColumn("_seen", F.col("attribut")), repair)
    keys = [c for c in known.columns if c != "_seen"]
    known = known.select("_seen", F.lit(True).alias("_known"), *[F.col(c).alias(f"_k_{c}") for c in keys])
    raw_cells = cells.withColumn("_raw", F.col("attribut"))
    joined = raw_cells.join(F.broadcast(known), F.col("_raw").eqNullSafe(F.col("_seen")), "left")
    # Known rows get their keys from the table; the CASE spares them the work of the others.
    known_row = F.col("_known").isNotNull()
    own = {c: F.when(known_row, F.col(f"_k_{c}")).otherwise(value) for c, value in _attribute_keys(F.col("_raw"), repair).items()}
    kept = [c for c in cells.columns if c not in own]
    return joined.select(*kept, *[value.alias(c) for c, value in own.items()])


def _order() -> Column:
    # Item and answer break ties, so a repeated row number still gives one result.
    return F.struct("row_no", "item", "reponse")


def _first(value: str, where: Column) -> Column:
    """Aggregate: first non-null value in row order among the rows of ``where``.

    The answer, itself part of the order, is kept once a visit and not beside it.
    """
    order = _order() if value == "reponse" else F.struct(_order().alias("order"), value)
    return F.min(F.when(where & F.col(value).isNotNull(), order))[value]


def _asked() -> Column:
    """What an identity question asks for; NULL for all other rows."""
    item_slug = F.col("item_slug")
    known = F.when(item_slug.isin(["prenom", "nom", "age"]), item_slug)
    return F.when(F.col("cat_slug") == IDENTITY, known.when(item_slug.startswith(IDENTITY), F.lit(IDENTITY)))


def _identity_aggregates(iso_day_first: bool, asked: Column) -> dict[str, Column]:
    first = {name: _first("reponse", asked == name) for name in ("prenom", "nom", "age")}
    code = _first("reponse", asked == IDENTITY)
    date = _first("date_entree", F.lit(True))
    return {
        "visit_no": F.min("row_no"),
        "n_lignes": F.count(F.lit(1)),
        "prenom": first["prenom"],
        "nom": first["nom"],
        "age": typed.age_from_text(first["age"]),
        "date_entree": typed.parse_entry_date(date, iso_day_first),
        "type_patient_code": typed.patient_type_code(code),
    }


def _keys_by_column(list_columns: Mapping[str, str]) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for key, column in list_columns.items():
        grouped.setdefault(column, []).append(key)
    return grouped


def _ticked(keys: list[str]) -> Column:
    return F.col("cat_slug").isin(keys) & F.col("reponse_on") & F.col("item").isNotNull()


def _key_rank(keys: list[str]) -> Column:
    return reduce(
        lambda rest, pair: F.when(F.col("cat_slug") == pair[1], F.lit(pair[0])).otherwise(rest),
        reversed(list(enumerate(keys))),
        F.lit(len(keys)),
    )


def _answer_order(keys: list[str]) -> Column:
    """Order of answers inside a column: by key in table order, then by row."""
    return F.struct(_key_rank(keys).alias("rank"), F.col("row_no"), F.col("item"))


def ticked_answers(eav: DataFrame, list_columns: Mapping[str, str] = LIST_COLUMNS) -> DataFrame:
    """Long form of the answer lists: one row per ticked answer, no shuffle.

    ``key_rank`` and ``row_no`` give the order inside a list. This form has no
    cell that grows with a visit.
    """
    ranks = {key: rank for rank, key in enumerate(list_columns)}
    pairs = [F.lit(x) for pair in list_columns.items() for x in pair]
    rank_pairs = [F.lit(x) for pair in ranks.items() for x in pair]
    return eav.filter(_ticked(list(list_columns))).select(
        *VISIT,
        F.try_element_at(F.create_map(*pairs), F.col("cat_slug")).alias("colonne"),
        F.try_element_at(F.create_map(*rank_pairs), F.col("cat_slug")).alias("key_rank"),
        "row_no",
        "item",
    )


def _by_visit(eav: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """One aggregation by visit.

    A hash of the visit leads the grouping, so that Spark's sort tells nearly
    all rows apart by eight bytes beside the pointer instead of reading two rows.
    """
    hashed = F.xxhash64(*VISIT).alias("_visit")
    return eav.groupBy(hashed, *VISIT).agg(*[v.alias(k) for k, v in aggregates.items()]).drop("_visit")


def pivot_visits(
    eav: DataFrame,
    list_columns: Mapping[str, str] = LIST_COLUMNS,
    iso_day_first: bool = False,
) -> DataFrame:
    """One row per visit with an ordered answer list per column, one shuffle.

    The lists are part of the result, so a cell is as long as its visit has
    ticked answers; ``ticked_answers`` is the form without such cells.

    Rows enter the aggregation with only what it reads, and lists are collected
    together, as an empty list costs shuffled and sorted rows about as much as
    an answer. Lists ``normalise_lists`` reads stand apart from the others, so
    that Spark still leaves out the others where nobody reads them.
    """
    by_column = _keys_by_column(list_columns)
    slots = [key for keys in by_column.values() for key in keys]
    narrow = eav.select(
        *VISIT, "row_no", "item", "reponse", "date_entree",
        F.when(_ticked(slots), _key_rank(slots)).alias("_slot"), _asked().alias("_asked"),
    )
    aggregates = _identity_aggregates(iso_day_first, F.col("_asked"))
    scalars = list(aggregates)
    group = {column: "_read" if column in READ_LISTS else "_others" for column in by_column}
    for name in sorted(set(group.values())):
        inside = [slots.index(key) for column, keys in by_column.items() if group[column] == name for key in keys]
        entry = F.when(F.col("_slot").isin(inside), F.struct("_slot", "row_no", "item"))
        aggregates[name] = F.sort_array(F.collect_list(entry))
    keep_lists_hashed(eav.sparkSession)
    visits = _by_visit(narrow, aggregates)
    lists = [
        _list_of(F.col(group[column]), [slots.index(key) for key in keys]).alias(column)
        for column, keys in by_column.items()
    ]
    return visits.select(*VISIT, *scalars, *lists)


def _list_of(entries: Column, slots: list[int]) -> Column:
    """Items of the sorted ``entries`` in a run of slots, NULL when there is none."""
    own = F.filter(entries, lambda e: (e["_slot"] >= slots[0]) & (e["_slot"] <= slots[-1]))
    return F.nullif(F.transform(own, lambda e: e["item"]), F.array().cast("array<string>"))


def _finish(df: DataFrame, repair: bool) -> DataFrame:
    """Columns derived from the scalar ones, shared by both ways in."""
    named = df.withColumns(
        {
            "type_patient": labels.patient_type(F.col("type_patient_code")),
            "categorie_diagnostique_large": labels.broad_category(
                F.col("type_patient_code"), F.col("diagnostic_categorie")
            ),
            "nom": text.clean_text(F.col("nom"), repair),
            "prenom": text.clean_text(F.col("prenom"), repair),
        }
    ).withColumns(
        {"nom_norm": text.slug(F.col("nom")), "prenom_norm": text.slug(F.col("prenom"))}
    )
    return named.withColumn(
        "nom_complet_norm", labels.full_name_key(F.col("prenom_norm"), F.col("nom_norm"))
    )


def normalise_lists(wide: DataFrame, repair: bool = True) -> DataFrame:
    """Normalise a table with answer lists, row by row and without a shuffle."""
    category, subtype = labels.harmonise_answers(F.col("diagnostic"))
    columns = {
        "sexe": labels.resolve_sex(F.col("sexe_brut")),
        "diagnostic_categorie": category,
        "trauma_type": subtype,
        **{new: labels.first_item(F.col(old)) for old, new in FIRST_ANSWERS.items()},
    }
    scalars = wide.withColumns(columns).withColumn("sexe_concordant", F.col("sexe").isNotNull())
    return _finish(scalars, repair)


def normalised_visits(
    eav: DataFrame,
    list_columns: Mapping[str, str] = LIST_COLUMNS,
    iso_day_first: bool = False,
    repair: bool = True,
) -> DataFrame:
    """Clean answers to normalised visits in one aggregation, without lists.

    Rows enter it with only what it reads: a number for the list an answer is
    of, bits for what is true of it, and the order once beside the value.
    """
    keys = _keys_by_column(list_columns)
    slots = [key for column in READ_LISTS for key in keys[column]]
    slug, slot = F.col("item_slug"), F.col("_slot")

    def within(column: str) -> Column:
        return slot.isin([slots.index(key) for key in keys[column]])

    # Keys that stand in several lists would need several numbers.
    assert len(set(slots)) == len(slots)
    placed = eav.select(
        *VISIT, "row_no", "item", "reponse", "date_entree", "item_slug", _asked().alias("_asked"),
        F.when(_ticked(slots), _key_rank(slots)).alias("_slot"),
    )
    # Item keys decide only for two lists; the CASE spares all other rows the work.
    category = F.when(within("diagnostic"), labels.diagnosis_category(slug))
    subtype = F.when(within("diagnostic"), labels.diagnosis_subtype(slug))
    narrow = placed.select(
        *VISIT, "row_no", "item", "reponse", "date_entree", "_asked", "_slot",
        category.alias("_category"), subtype.alias("_subtype"),
        *[(within("sexe_brut") & (slug == sex)).alias(f"_{sex}") for sex in ("homme", "femme")],
    )
    true_of = {"_homme": F.col("_homme"), "_femme": F.col("_femme"), "_answered": within("diagnostic")}
    true_of |= {f"_{name}": F.col("_category") == name for name in labels.PRIORITY}
    bits = sum((F.when(truth, 1 << i).otherwise(0) for i, truth in enumerate(true_of.values())), F.lit(0))
    aggregates = _identity_aggregates(iso_day_first, F.col("_asked"))
    order = F.struct("_slot", "row_no", "item")
    for old, new in FIRST_ANSWERS.items():
        aggregates[new] = F.min(F.when(within(old), order))["item"]
    for new, value in (("_first_known", "_category"), ("trauma_type", "_subtype")):
        aggregates[new] = F.min(F.when(F.col(value).isNotNull(), F.struct("_slot", "row_no", "item", value)))[value]
    aggregates["_true"] = F.bit_or(bits)

    visits = _by_visit(narrow, aggregates)
    truth = {name: F.col("_true").bitwiseAND(1 << i) != 0 for i, name in enumerate(true_of)}
    scalars = visits.withColumns(
        {
            "sexe": labels.sex_from_flags(truth["_homme"], truth["_femme"]),
            "diagnostic_categorie": labels.prioritised(
                truth["_answered"],
                F.col("_first_known"),
                {name: truth[f"_{name}"] for name in labels.PRIORITY},
            ),
        }
    ).withColumn("sexe_concordant", F.col("sexe").isNotNull())
    return _finish(scalars.drop(*[c for c in scalars.columns if c.startswith("_")]), repair)
