"""Standard categories: fixed dimensions and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import clean_text, slug

# Answer key -> (standard category, trauma subtype).
DIAGNOSES = (
    ("coupetblessures", "TRAUMA", "Coups et blessures"),
    ("accidentsdomestiques", "TRAUMA", "Accident domestique"),
    ("accidentsdelacirculation", "TRAUMA", "Accident de la circulation"),
    ("accidentmoto", "TRAUMA", "Accident moto"),
    ("accidentcharrette", "TRAUMA", "Accident charrette"),
    ("affectionscardiovasculaires", "CARDIOVASCULAIRE", None),
    ("diabeteetautresaffectionsmetaboliques", "METABOLIQUE", None),
    ("cassuspectdepaludisme", "INFECTIEUX_PALUDISME", None),
    ("casconfirmedepaludisme", "INFECTIEUX_PALUDISME", None),
    ("cassuspectcovid19", "INFECTIEUX_COVID19", None),
    ("casconfirmedecovid19", "INFECTIEUX_COVID19", None),
    ("affectionsrespiratoires", "RESPIRATOIRE", None),
    ("gastroenteriteaiguintoxication", "DIGESTIF", None),
    ("affectionsdigestives", "DIGESTIF", None),
    ("affectionsbuccodentaires", "BUCCODENTAIRE", None),
    ("affectionsophtalmologiques", "OPHTALMOLOGIQUE", None),
    ("affectionsobstetricales", "MATERNITE_GYNECOLOGIE", None),
    ("affectionsgynecologiques", "MATERNITE_GYNECOLOGIE", None),
    ("affectionsurologiques", "UROLOGIQUE", None),
    ("affectionsrhumatologiques", "RHUMATOLOGIQUE", None),
    ("affectionsdermatologiques", "DERMATOLOGIQUE", None),
    ("affectionsneuropsychatriques", "NEUROPSYCHIATRIQUE", None),
    ("coupdechaleur", "COUP_DE_CHALEUR", None),
    ("affectionsorl", "ORL", None),
    ("arrivedecedecorpssansvie", "DECES", None),
    ("siautrepreciser", "AUTRE", None),
)
DIAGNOSIS_SCHEMA = (
    "item_slug string, categorie_standardisee string, sous_type_trauma string"
)

# Standard category -> code-system texts.
CODE_SYSTEMS = (
    (
        "TRAUMA",
        "NE60-NF07 (Injury, poisoning)",
        "417163006 | Traumatic injury (disorder)",
    ),
    (
        "RESPIRATOIRE",
        "CA00-CB7Z (Respiratory system diseases)",
        "50043002 | Disorder of respiratory system (disorder)",
    ),
    (
        "DIGESTIF",
        "DA00-DE2Z (Digestive system diseases)",
        "235352002 | Disorder of digestive tract (disorder)",
    ),
)
CODE_SCHEMA = "categorie_standard string, icd11 string, snomed_ct string"

# Category and patient-type labels.
BROAD_LABELS = {
    "TRAUMA": "Trauma",
    "MATERNITE_GYNECOLOGIE": "Maternite/Gynecologie",
}
BROAD_DEFAULT = "Medical"
BROAD_BY_PATIENT_TYPE = {"P": "Pediatrie", "M": "Maternite/Gynecologie"}
PATIENT_TYPES = {
    "U": "Urgences",
    "E": "Consultation externe",
    "P": "Pediatrie",
    "M": "Maternite-Gynecologie",
}
OTHER = "AUTRE"
PRIORITY = ("DECES", "TRAUMA")
MALE, FEMALE = "Homme", "Femme"

PLAUSIBLE_DIAGNOSES = tuple(sorted({row[1] for row in DIAGNOSES} | {OTHER}))


def diagnosis_table(spark: SparkSession) -> DataFrame:
    """The harmonisation dimension as a table."""
    return spark.createDataFrame(list(DIAGNOSES), DIAGNOSIS_SCHEMA)


def code_table(spark: SparkSession) -> DataFrame:
    """The category to code-system dimension as a table."""
    return spark.createDataFrame(list(CODE_SYSTEMS), CODE_SCHEMA)


def lookup(code: Column, mapping: dict[str, str]) -> Column:
    """Value of ``code`` in a small fixed mapping, NULL when absent."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(pairs, code)


def diagnosis_category(item_slug: Column) -> Column:
    return lookup(item_slug, {key: category for key, category, _ in DIAGNOSES})


def diagnosis_subtype(item_slug: Column) -> Column:
    return lookup(item_slug, {key: sub for key, _, sub in DIAGNOSES if sub})


def patient_type(code: Column) -> Column:
    return lookup(code, PATIENT_TYPES)


def first_item(answers: Column) -> Column:
    """Head of an answer list, NULL when there is none."""
    return F.try_element_at(answers, F.lit(1))


def sex_from_flags(male: Column, female: Column) -> Column:
    """The sex when exactly one of both boxes is ticked."""
    return F.when(male & ~female, F.lit(MALE)).when(female & ~male, F.lit(FEMALE))


def resolve_sex(answers: Column) -> Column:
    """Sex from an answer list; NULL when none or both are ticked."""
    keys = F.transform(F.coalesce(answers, F.array().cast("array<string>")), slug)
    return sex_from_flags(
        F.array_contains(keys, "homme"), F.array_contains(keys, "femme")
    )


def prioritised(
    answered: Column, first_known: Column, present: dict[str, Column]
) -> Column:
    """Category of a visit: priority categories first, then answer order."""
    category = F.when(~answered, F.lit(None).cast("string")).when(
        first_known.isNull(), F.lit(OTHER)
    )
    for name in PRIORITY:
        category = category.when(present[name], F.lit(name))
    return category.otherwise(first_known)


def harmonise_answers(answers: Column) -> tuple[Column, Column]:
    """(category, trauma subtype) of an ordered answer list, without a shuffle."""
    filled = F.coalesce(answers, F.array().cast("array<string>"))
    keys = F.transform(filled, slug)
    categories = F.filter(F.transform(keys, diagnosis_category), F.isnotnull)
    subtypes = F.filter(F.transform(keys, diagnosis_subtype), F.isnotnull)
    category = prioritised(
        F.size(filled) > 0,
        first_item(categories),
        {name: F.array_contains(categories, name) for name in PRIORITY},
    )
    return category, first_item(subtypes)


def broad_category(type_code: Column, category: Column) -> Column:
    """Report grouping: the patient type decides first, then the category."""
    by_type = lookup(type_code, BROAD_BY_PATIENT_TYPE)
    return F.coalesce(by_type, lookup(category, BROAD_LABELS), F.lit(BROAD_DEFAULT))


def with_codes(df: DataFrame, column: str = "diagnostic_categorie") -> DataFrame:
    """Add the code-system texts of a category; three fixed rows are broadcast."""
    codes = code_table(df.sparkSession)
    return df.join(
        F.broadcast(codes), df[column] == codes["categorie_standard"], "left"
    ).drop("categorie_standard")


def name_key(name: Column, repair: bool = True) -> Column:
    """Key of one name: cleaned again, then without accents and spaces."""
    return slug(clean_text(name, repair))


def full_name_key(first_key: Column, last_key: Column) -> Column:
    return F.trim(F.concat(first_key, F.lit(" "), last_key))
