"""Reading raw and clean tables, writing results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typed import TYPED_TIME

# Names given by position to the columns of a raw export.
RAW_COLUMNS = ("titre", "attribut", "patient", "dossier", "date_entree", "reponse")
ORDER_COLUMN = "row_no"
RAW_SCHEMA = "row_no bigint, titre string, attribut string, patient string, dossier string, date_entree string, reponse string"

# Columns of the exported clean table.
CLEAN_SCHEMA = (
    "dossier string, annee int, age int, age_imp double, sexe string, "
    "sexe_imp string, provenance string, service_principal string, "
    "type_patient string, diagnostic_categorie string, "
    "diagnostic_categorie_imp string, trauma_type string, "
    "categorie_diagnostique_large string, typologie_cas string, "
    "evolution_immediate string, duree_hospitalisation string, "
    "date_entree timestamp_ntz"
)
CLEAN_COLUMNS = tuple(part.split()[0] for part in CLEAN_SCHEMA.split(", "))


# Columns that a raw export may leave out of a clean table; they are NULL then.
OPTIONAL_CLEAN = ("trauma_type",)


def _raw_cell(df: DataFrame, name: str) -> Column:
    """A cell as text. Real times are written year first, which is read back unambiguously."""
    cell = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(cell, TYPED_TIME)
    return cell.cast("string")


def raw_eav(df: DataFrame, year: int, order_column: str = ORDER_COLUMN) -> DataFrame:
    """Name the six raw columns by position and add the year.

    Row order has meaning in this data, and Spark tables have none, so the
    input has to carry it in ``order_column``; that column may stand anywhere.
    """
    if order_column not in df.columns:
        raise ValueError(f"raw answers need their row order in {order_column!r}")
    values = [c for c in df.columns if c != order_column]
    if len(values) != len(RAW_COLUMNS):
        raise ValueError(f"expected {len(RAW_COLUMNS)} columns, found {len(values)}")
    return df.select(
        F.col(order_column).cast("bigint").alias(ORDER_COLUMN),
        *[_raw_cell(df, old).alias(new) for old, new in zip(values, RAW_COLUMNS)],
        F.lit(year).cast("int").alias("annee"),
    )


def read_raw_eav(spark: SparkSession, path: str, year: int, fmt: str = "parquet", **options) -> DataFrame:
    """One yearly export from parquet, or from CSV in the order of RAW_SCHEMA."""
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.options(**{**_CSV, **options}).option("enforceSchema", True).schema(RAW_SCHEMA)
    return raw_eav(reader.format(fmt).load(path), year)


def read_raw_years(spark: SparkSession, paths: dict[int, str], fmt: str = "parquet", **options) -> DataFrame:
    """Bag union of several yearly exports."""
    years = [read_raw_eav(spark, path, year, fmt, **options) for year, path in sorted(paths.items())]
    return reduce(DataFrame.unionByName, years)


@dataclass
class Read:
    """Rows of a table with their types, and what could not be read: column, value, number of rows."""

    rows: DataFrame
    rejects: DataFrame


# CSV as most programs write it: quotes are doubled, blanks belong to the value.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def rejected(text_rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Values that are there but can't be read as their type, counted: ``colonne``, ``valeur``, ``n``.

    Empty text stands for a missing value and is not counted.
    """
    typed = {c: kind for c, kind in kinds.items() if kind != "string" and c in text_rows.columns}
    if not typed:
        return text_rows.sparkSession.createDataFrame([], "colonne string, valeur string, n bigint")
    bad = [
        F.when((F.trim(f"`{c}`") != "") & F.col(f"`{c}`").try_cast(kind).isNull(), F.struct(F.lit(c).alias("colonne"), F.col(f"`{c}`").alias("valeur")))
        for c, kind in typed.items()
    ]
    found = text_rows.select(F.explode(F.array_compact(F.array(*bad))).alias("r"))
    return found.groupBy("r.colonne", "r.valeur").agg(F.count(F.lit(1)).alias("n"))


def read_raw_checked(spark: SparkSession, path: str, year: int) -> Read:
    """One yearly CSV export. Rows whose row number can't be read have no place in the order and are rejected."""
    names = [part.split()[0] for part in RAW_SCHEMA.split(", ")]
    text = spark.read.options(**_CSV).schema(", ".join(f"{c} string" for c in names)).option("enforceSchema", True).csv(path)
    number = F.col(ORDER_COLUMN).try_cast("bigint")
    shown = text.withColumn(ORDER_COLUMN, F.coalesce(ORDER_COLUMN, F.lit("(none)")))
    rows = raw_eav(text.withColumn(ORDER_COLUMN, number).filter(F.col(ORDER_COLUMN).isNotNull()), year)
    return Read(rows, rejected(shown, {ORDER_COLUMN: "bigint"}))


def read_clean_checked(spark: SparkSession, path: str) -> Read:
    """Clean table from CSV with a header; columns are found by their trimmed names.

    Their order has no meaning and further columns are left out. A missing
    column is an error unless it is one of OPTIONAL_CLEAN. Empty cells are NULL.
    Values that can't be read as their type are NULL in the rows and counted in
    the rejects.
    """
    rows = trim_names(spark.read.options(**_CSV).csv(path))
    kinds = dict(part.split() for part in CLEAN_SCHEMA.split(", "))
    missing = [c for c in kinds if c not in rows.columns and c not in OPTIONAL_CLEAN]
    if missing:
        raise ValueError(f"clean table lacks the columns {missing}")
    found = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None)
    typed = rows.select(*[found(c).try_cast(kind).alias(c) for c, kind in kinds.items()])
    return Read(typed, rejected(rows, kinds))


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_clean_checked``."""
    return read_clean_checked(spark, path).rows


def trim_names(df: DataFrame) -> DataFrame:
    """Same table with blanks around column names removed."""
    return df.toDF(*[name.strip() for name in df.columns])


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Result table as CSV with a header; times as ``2023-09-01 08:15:00``.

    ``compression`` (such as ``gzip``) is for large exports; readers see it by the file names.
    """
    times = {
        name: F.col(name).cast("string")
        for name, kind in df.dtypes
        if kind in ("timestamp", "timestamp_ntz")
    }
    df.withColumns(times).write.mode("overwrite").options(**_CSV).csv(path, compression=compression)


def write_by_year(df: DataFrame, path: str) -> None:
    """Large visit table as parquet, one folder per year for pruning."""
    df.write.mode("overwrite").partitionBy("annee").parquet(path)
