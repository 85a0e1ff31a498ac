"""SQL twins of the engine's expressions, for the oracle."""

from __future__ import annotations

from recordloom.functions import labels, typed
from recordloom.functions.text import ENCODING_MARKERS, encoding_tables

# Regular-expression class of white space in the oracle's dialect.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def repaired(x: str) -> str:
    source, target, encodable = encoding_tables()
    return (
        f"CASE WHEN regexp_matches({x}, '[{ENCODING_MARKERS}]') AND NOT regexp_matches({x}, '[^\\x00-\\x7f{encodable}]') "
        f"THEN translate({x}, {quoted(source)}, {quoted(target)}) ELSE {x} END"
    )


def cleaned(x: str) -> str:
    escaped = f"replace(replace({repaired(x)}, '_x0019_', '’'), '_x0013_', '-')"
    return f"nullif(trim(regexp_replace({escaped}, '{_SPACE}', ' ', 'g')), '')"


def slug(x: str) -> str:
    return f"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^a-zA-Z0-9]', '', 'g'))"


def soundex(name: str) -> str:
    """Soundex of the first word, for words of letters."""
    word = f"upper(split_part({name}, ' ', 1))"
    head = f"translate(substring({word}, 1, 1), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556')"
    rest = f"replace(translate(substring({word}, 2), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556'), '7', '')"
    codes = f"concat({head}, {rest})"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN {name} = '' THEN '' ELSE concat(substring({word}, 1, 1), substring(concat(replace(substring({codes}, 2), '0', ''), '000'), 1, 3)) END"


def age_band(age: str) -> str:
    cases = " ".join(f"WHEN {age} >= {edge} THEN '{name}'" for edge, name in reversed(typed.AGE_BANDS))
    return f"CASE {cases} END"


def age_band_order(age: str) -> str:
    cases = " ".join(f"WHEN {age} >= {edge} THEN {i}" for i, (edge, _) in reversed(list(enumerate(typed.AGE_BANDS))))
    return f"CASE {cases} END"


def mapped(x: str, mapping: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in mapping.items()) + " END"


def diagnosis_category(x: str) -> str:
    return mapped(x, {k: c for k, c, _ in labels.DIAGNOSES})


def diagnosis_subtype(x: str) -> str:
    return mapped(x, {k: s for k, _, s in labels.DIAGNOSES if s})


def broad(code: str, category: str) -> str:
    return f"coalesce({mapped(code, labels.BROAD_BY_PATIENT_TYPE)}, {mapped(category, labels.BROAD_LABELS)}, 'Medical')"


def rounded(x: str, places: int = 1) -> str:
    """Scale, round half to even, scale back."""
    scale = float(10**places)
    return f"(CAST(round_even({x} * {scale}, 0) AS DOUBLE) / {scale})"


CLEAN_ANSWERS_SQL = f"""
cells AS (
  SELECT row_no, annee, date_entree, {cleaned('attribut')} AS attribut, {cleaned('dossier')} AS dossier, {cleaned('reponse')} AS reponse FROM raw
),
eav AS (
  SELECT *, coalesce(lower(trim(reponse)) = 'on', FALSE) AS reponse_on, {slug('categorie')} AS cat_slug, {slug('item')} AS item_slug
  FROM (SELECT *, trim(split_part(coalesce(attribut, ''), ':', 1)) AS categorie,
               CASE WHEN strpos(attribut, ':') > 0 THEN trim(substring(attribut, strpos(attribut, ':') + 1)) END AS item
        FROM cells WHERE dossier IS NOT NULL) c
)"""


def _first(value: str, where: str) -> str:
    return f"(list({value} ORDER BY row_no, item) FILTER (WHERE ({where}) AND {value} IS NOT NULL))[1]"


def _ticks(*keys: str) -> str:
    names = ", ".join(map(quoted, keys))
    return f"cat_slug IN ({names}) AND reponse_on AND item IS NOT NULL"


def _day(text: str) -> str:
    iso = f"try_strptime({text}, '%Y-%m-%d %H:%M')"
    return f"coalesce({iso}, try_strptime({text}, '%d/%m/%Y %H:%M'))"


def _age(text: str) -> str:
    number = f"TRY_CAST(regexp_extract({text}, '([0-9]{{1,3}})', 1) AS INTEGER)"
    return f"CASE WHEN {number} BETWEEN 0 AND 120 THEN {number} END"


def _code(text: str) -> str:
    return f"nullif(regexp_extract(upper({text}), '^\\s*([UEPM])', 1), '')"


_DIAG = _ticks("diagnosticretenuouevoque")
_IDENT = "cat_slug = 'identifiant'"

PIVOT_SQL = f"""
facts AS (
  SELECT annee, dossier, min(row_no) AS visit_no, count(*) AS n_lignes,
    {_first('reponse', _IDENT + " AND item_slug = 'prenom'")} AS prenom,
    {_first('reponse', _IDENT + " AND item_slug = 'nom'")} AS nom,
    {_first('reponse', _IDENT + " AND item_slug = 'age'")} AS age_text,
    {_first('reponse', _IDENT + " AND starts_with(item_slug, 'identifiant')")} AS code_text,
    {_first('date_entree', 'TRUE')} AS date_text,
    coalesce(bool_or({_ticks('sexe')} AND item_slug = 'homme'), FALSE) AS homme,
    coalesce(bool_or({_ticks('sexe')} AND item_slug = 'femme'), FALSE) AS femme,
    {_first('item', _ticks('provenance'))} AS provenance,
    {_first('item', _ticks('service'))} AS service_principal,
    {_first('item', _ticks('typologieducas'))} AS typologie_cas,
    {_first('item', _ticks('evolutionimmediatedansles24h'))} AS evolution_immediate,
    {_first('item', _ticks('dureeapproximativedhospitalisation'))} AS duree_hospitalisation,
    coalesce(bool_or({_DIAG}), FALSE) AS answered,
    {_first(diagnosis_category('item_slug'), _DIAG)} AS first_known,
    {_first(diagnosis_subtype('item_slug'), _DIAG)} AS trauma_type,
    coalesce(bool_or({_DIAG} AND {diagnosis_category('item_slug')} = 'DECES'), FALSE) AS deces,
    coalesce(bool_or({_DIAG} AND {diagnosis_category('item_slug')} = 'TRAUMA'), FALSE) AS trauma
  FROM eav GROUP BY annee, dossier
),
normalised AS (
  SELECT annee, dossier, visit_no, n_lignes, {_age('age_text')} AS age, {_day('date_text')} AS date_entree,
    {_code('code_text')} AS type_patient_code, {mapped(_code('code_text'), labels.PATIENT_TYPES)} AS type_patient,
    CASE WHEN homme AND NOT femme THEN 'Homme' WHEN femme AND NOT homme THEN 'Femme' END AS sexe,
    homme <> femme AS sexe_concordant, provenance, service_principal, typologie_cas, evolution_immediate, duree_hospitalisation,
    CASE WHEN NOT answered THEN NULL WHEN first_known IS NULL THEN 'AUTRE' WHEN deces THEN 'DECES' WHEN trauma THEN 'TRAUMA' ELSE first_known END AS diagnostic_categorie,
    trauma_type, trim(concat({slug('prenom')}, ' ', {slug('nom')})) AS nom_complet_norm
  FROM facts
),
visits AS (SELECT *, {broad('type_patient_code', 'diagnostic_categorie')} AS categorie_diagnostique_large FROM normalised)"""


def imputed_sql(source: str = "visits", name: str = "imputed") -> str:
    """Median and smallest-mode filling per year."""
    def mode(column: str) -> str:
        return (
            f"(SELECT annee, {column} AS m FROM (SELECT annee, {column}, row_number() OVER (PARTITION BY annee ORDER BY count(*) DESC, {column}) AS rn "
            f"FROM {source} WHERE {column} IS NOT NULL GROUP BY annee, {column}) t WHERE rn = 1)"
        )

    return f"""
{name} AS (
  SELECT v.*, coalesce(CAST(v.age AS DOUBLE), a.m) AS age_imp, coalesce(v.sexe, s.m, 'Homme') AS sexe_imp,
         coalesce(v.diagnostic_categorie, d.m, 'AUTRE') AS diagnostic_categorie_imp
  FROM {source} v
  LEFT JOIN (SELECT annee, median(CAST(age AS DOUBLE)) AS m FROM {source} GROUP BY annee) a ON a.annee = v.annee
  LEFT JOIN {mode('sexe')} s ON s.annee = v.annee
  LEFT JOIN {mode('diagnostic_categorie')} d ON d.annee = v.annee
)"""


_GAP = "abs(CAST(floor((epoch_us(i.date_entree) - epoch_us(j.date_entree)) / 86400000000.0) AS BIGINT))"
_NO_DATE = "(i.date_entree IS NULL OR j.date_entree IS NULL)"
_SIM = "jaro_winkler_similarity(i.nom_complet_norm, j.nom_complet_norm)"
SCORE = (
    f"0.7::DOUBLE * {_SIM} + 0.2::DOUBLE * (1 - least(abs(i.age - j.age) / 2.0::DOUBLE, 1.0::DOUBLE)) "
    f"+ 0.1::DOUBLE * CASE WHEN {_NO_DATE} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - least({_GAP}, 1) END"
)


def keep_first_sql(source: str, rounds: int = 14, threshold: float = 0.85) -> str:
    """The order rule on visits, as rounds over the match graph; ends in ``kept``."""
    parts = [
        f"keyed AS MATERIALIZED (SELECT annee, visit_no, nom_complet_norm, sexe, age, date_entree, {soundex('nom_complet_norm')} AS block FROM {source})",
        f"""edges AS MATERIALIZED (
  SELECT i.annee, i.visit_no AS i, j.visit_no AS j FROM keyed i JOIN keyed j
    ON i.annee = j.annee AND i.block = j.block AND i.sexe = j.sexe AND i.visit_no < j.visit_no
  WHERE i.block <> '' AND abs(i.age - j.age) <= 2 AND ({_NO_DATE} OR {_GAP} <= 1) AND {SCORE} >= {threshold}
)""",
        "s0 AS MATERIALIZED (SELECT annee, visit_no, 0 AS st FROM keyed)",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"""s{r} AS MATERIALIZED (
  SELECT s.annee, s.visit_no, CASE WHEN s.st <> 0 THEN s.st WHEN p.kept > 0 THEN 2 WHEN coalesce(p.open, 0) = 0 THEN 1 ELSE 0 END AS st
  FROM s{r - 1} s LEFT JOIN (
    SELECT e.annee, e.j, sum(CASE WHEN t.st = 1 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN t.st = 0 THEN 1 ELSE 0 END) AS open
    FROM edges e JOIN s{r - 1} t ON t.annee = e.annee AND t.visit_no = e.i GROUP BY e.annee, e.j
  ) p ON p.annee = s.annee AND p.j = s.visit_no
)"""
        )
    # Rows still open after the last round would be lost, and so be noticed.
    parts.append(f"kept AS MATERIALIZED (SELECT annee, visit_no FROM s{rounds} WHERE st = 1)")
    return ",\n".join(parts)


PAIRS_SQL = """
first_match AS (
  SELECT e.annee, e.j, min(e.i) AS m FROM edges e JOIN kept k ON k.annee = e.annee AND k.visit_no = e.i GROUP BY e.annee, e.j
),
pairs AS (
  SELECT j.annee, count(*) AS n FROM keyed j
  JOIN keyed i ON i.annee = j.annee AND i.block = j.block AND i.visit_no < j.visit_no
  JOIN kept k ON k.annee = i.annee AND k.visit_no = i.visit_no
  LEFT JOIN first_match f ON f.annee = j.annee AND f.j = j.visit_no
  WHERE j.block <> '' AND (f.m IS NULL OR i.visit_no <= f.m) GROUP BY j.annee
)"""


def report_sql(source: str) -> str:
    return f"""
report AS (
  SELECT b.annee, b.n AS n_avant, coalesce(a.n, 0) AS n_apres, b.n - coalesce(a.n, 0) AS n_doublons_supprimes,
         {rounded('(100 * (b.n - coalesce(a.n, 0)))::DOUBLE / b.n', 2)} AS taux_doublons_pct, coalesce(p.n, 0) AS n_paires_evaluees
  FROM (SELECT annee, count(*) AS n FROM {source} GROUP BY annee) b
  LEFT JOIN (SELECT annee, count(*) AS n FROM kept GROUP BY annee) a ON a.annee = b.annee
  LEFT JOIN pairs p ON p.annee = b.annee
)"""


# --- tail probabilities by numerical integration -----------------------------

_STEPS = 4000
_WEIGHT = f"(CASE WHEN g.i IN (0, {_STEPS}) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END)"


def _simpson(density: str, upper: str) -> str:
    """Integral from 0 to ``upper`` of ``density`` of ``(g.i * h)``."""
    body = density.replace("$x", f"(g.i * ({upper}) / {_STEPS}.0::DOUBLE)")
    return f"(SELECT sum({_WEIGHT} * ({body})) FROM range({_STEPS + 1}) g(i)) * ({upper}) / {_STEPS * 3}.0::DOUBLE"


def normal_p(z: str) -> str:
    return f"(1 - 2 * {_simpson('exp(-$x * $x / 2) / sqrt(2 * pi())', f'abs({z})')})"


def chi_square_p(x: str, dof: str) -> str:
    density = f"2 * pow($x, {dof} - 1) * exp(-$x * $x / 2) / (pow(2, {dof} / 2.0::DOUBLE) * exp(lgamma({dof} / 2.0::DOUBLE)))"
    return f"(1 - {_simpson(density, f'sqrt({x})')})"


def t_p(t: str, dof: str) -> str:
    constant = f"exp(lgamma(({dof} + 1) / 2.0::DOUBLE) - lgamma({dof} / 2.0::DOUBLE)) / sqrt({dof} * pi())"
    return f"(1 - 2 * {_simpson(f'{constant} * pow(1 + $x * $x / {dof}, -({dof} + 1) / 2.0::DOUBLE)', f'abs({t})')})"
