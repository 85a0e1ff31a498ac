import datetime as dt
import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.functions import labels, similarity, text, typed


def apply(spark, expression, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_encoding_examples(spark):
    given = ["AntÈcÈdents", "Conduite ‡ tenir", "Tranche dâge", "Élève à Ê", "Ça va", None]
    want = ["Antécédents", "Conduite à tenir", "Tranche dâge", "Élève à Ê", "‚a va", None]
    assert apply(spark, text.repair_encoding, given) == want


def test_encoding_against_codecs(spark):
    def codec(value):
        if not any(m in value for m in text.ENCODING_MARKERS):
            return value
        try:
            return value.encode("mac_roman").decode("cp1252")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return value

    rng = random.Random(1)
    alphabet = (
        [bytes([b]).decode("mac_roman") for b in range(32, 256)]
        + list(text.ENCODING_MARKERS) * 6
        + list("abc ")
        * 10
        + list("ŁДあ")
    )
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(4000)]
    assert apply(spark, text.repair_encoding, values) == [codec(v) for v in values]


def test_clean_text(spark):
    given = [" a \t b ", "l_x0019_eau", "  ", None, "a  b", "x_x0013_y", "\x1fq\x85"]
    want = ["a b", "l’eau", None, None, "a b", "x-y", "q"]
    assert apply(spark, text.clean_text, given) == want
    kept = apply(spark, lambda c: text.clean_text(c, repair=False), ["Ça va"])
    assert kept == ["Ça va"]


def test_slug_examples(spark):
    given = ["Tranche d'âge", "½", "œ", None, "Ⅳ", "ﬁn", "𝐀b", "K"]
    assert apply(spark, text.slug, given) == ["tranchedage", "12", "", "", "iv", "fin", "ab", "k"]


def test_slug_against_unicode_database(spark):
    def plain(value):
        value = unicodedata.normalize("NFKD", value)
        return "".join(c for c in value if c.isascii() and c.isalnum()).lower()

    rng = random.Random(2)
    codes = [c for c in range(0x20, 0x2FFF)] + [0x1D400, 0x1F130, 0xFB01, 0xFF21]
    values = ["".join(chr(rng.choice(codes)) for _ in range(6)) for _ in range(4000)]
    values += [chr(c) + "z" for c in range(0x80, 0xD800)]
    values += [chr(c) + "z" for c in range(0x1D400, 0x1D800)]
    assert apply(spark, text.slug, values) == [plain(v) for v in values]


def test_attribute_and_tick(spark):
    given = ["Sexe : Homme", "a : b : c", "abc", None, "x:"]
    assert apply(spark, text.attribute_category, given) == ["Sexe", "a", "abc", "", "x"]
    assert apply(spark, text.attribute_item, given) == ["Homme", "b : c", None, None, ""]
    assert apply(spark, text.is_ticked, ["on", " ON ", "off", None]) == [True, True, False, False]


def test_age(spark):
    given = ["16 ans", "1985", "trente", "121", "-5", "6 mois", "2.5", None, "٣٠", "120"]
    assert apply(spark, typed.age_from_text, given) == [16, None, None, None, 5, 6, 2, None, 30, 120]


def test_dates(spark):
    given = ["13/09/2023", "03-09-2023", "bad", "2023-09-03", "09-13-2023", "1/2/2023 7:05", "30/02/2023", None,
             "2023-09-03T10:11:12", "2023-09-03 10:11:12.5"]
    d = dt.datetime
    want = [d(2023, 9, 13), d(2023, 9, 3), None, d(2023, 9, 3), d(2023, 9, 13), d(2023, 2, 1, 7, 5), None, None,
            d(2023, 9, 3, 10, 11, 12), d(2023, 9, 3, 10, 11, 12, 500000)]
    assert apply(spark, typed.parse_entry_date, given) == want
    day_first = apply(spark, lambda c: typed.parse_entry_date(c, iso_day_first=True), ["2023-09-03"])
    assert day_first == [d(2023, 3, 9)]


def test_more_written_dates(spark):
    d = dt.datetime
    want = {
        "03/09/23": d(2023, 9, 3), "3.9.68": d(2068, 9, 3), "03-09-69 7:05": d(1969, 9, 3, 7, 5), "09/13/23": d(2023, 9, 13),
        "3 Sep 2023": d(2023, 9, 3), "03-sept-23": d(2023, 9, 3), "13 SEPTEMBER 2023 10:11:12": d(2023, 9, 13, 10, 11, 12),
        "September 3, 2023": d(2023, 9, 3), "May 3 2023 9:05 pm": d(2023, 5, 3, 21, 5), "31 Feb 2023": None, "3 Sap 2023": None,
        "September 2023": d(2023, 9, 1), "20230903": d(2023, 9, 3), "20230903T10:11:12": d(2023, 9, 3, 10, 11, 12), "20231309": None,
        "2023-09-03T10:00:00Z": d(2023, 9, 3, 10), "2023-09-03 10:00:00+00:00": d(2023, 9, 3, 10),
        "2023-09-03T23:30:00.250-0500": d(2023, 9, 3, 23, 30, 0, 250000), "03/09/2023 10:00 PM": d(2023, 9, 3, 22),
        "03/09/2023 12:10 am": d(2023, 9, 3, 0, 10), "03/09/2023 12:10 P.M.": d(2023, 9, 3, 12, 10), "03/09/2023 13:00 PM": None,
        "03/09/202": None, "vers 3 Sep 2023": None, "2023-09": d(2023, 9, 1), "09/2023": d(2023, 9, 1), "1985": d(1985, 1, 1),
        "Sunday 3 September 2023": d(2023, 9, 3), "sun, 3 sep 2023 10h30": d(2023, 9, 3, 10, 30), "20230903T101112": d(2023, 9, 3, 10, 11, 12),
        "03/09/2023 10:11:12.123456789": d(2023, 9, 3, 10, 11, 12, 123456), "2023-13": None, "13/2023": None, "2023-09-03 25:00": None,
        "09/23": None, "": None, " ": None, "a|b": None, "\u0001|2023|1||1|||||||": None, "12345": None, "3 Sep 99": d(1999, 9, 3),
    }
    got = dict(zip(want, apply(spark, typed.parse_entry_date, list(want))))
    assert got == want
    assert apply(spark, lambda c: typed.parse_entry_date(c, iso_day_first=True), ["20230903", "2023-09-03T10:00Z"]) == [
        d(2023, 9, 3), d(2023, 3, 9, 10)
    ]


def test_offsets_are_taken_off_on_demand(spark):
    d = dt.datetime
    want = {
        "2023-09-03T10:00:00Z": d(2023, 9, 3, 10), "2023-09-03 01:00:00+02:00": d(2023, 9, 2, 23), "2023-09-03T10:00-0530": d(2023, 9, 3, 15, 30),
        "03/09/2023 23:30 +01": d(2023, 9, 3, 22, 30), "2023-09-03 10:00": d(2023, 9, 3, 10), "2023-09-03 10:00 GMT": d(2023, 9, 3, 10), "bad": None,
    }
    got = dict(zip(want, apply(spark, lambda c: typed.parse_entry_date(c, to_utc=True), list(want))))
    assert got == want


def test_codes_and_bands(spark):
    assert apply(spark, typed.patient_type_code, ["u12", " pX", "xU", None]) == ["U", "P", None, None]
    ages = [0.0, 4.9, 5.0, 75.0, 130.0, -1.0, None]
    assert apply(spark, typed.age_band, ages, "double") == ["0-4", "0-4", "5-14", "75+", "75+", None, None]
    assert apply(spark, typed.age_band_order, ages, "double") == [0, 0, 1, 6, 6, None, None]
    day = [dt.datetime(2023, 9, 3, 5)]
    assert apply(spark, typed.weekday_name, day, "timestamp_ntz") == ["Sunday"]


def test_sex_and_diagnosis(spark):
    sexes = [["Homme"], ["Homme", "Femme"], [], None, ["FEMME ", "x"]]
    assert apply(spark, labels.resolve_sex, sexes, "array<string>") == ["Homme", None, None, None, "Femme"]
    answers = [
        ["Affections ORL", "Accident moto"],
        ["Accident moto", "Arrivé décédé (corps sans vie)"],
        ["xyz"],
        None,
        [],
        ["Affections ORL", "Affections urologiques"],
    ]
    pick = lambda i: (lambda c: labels.harmonise_answers(c)[i])
    assert apply(spark, pick(0), answers, "array<string>") == ["TRAUMA", "DECES", "AUTRE", None, None, "ORL"]
    assert apply(spark, pick(1), answers, "array<string>") == [
        "Accident moto", "Accident moto", None, None, None, None]


def test_broad_category(spark):
    rows = [("P", "TRAUMA"), ("U", None), ("U", "TRAUMA"), (None, "MATERNITE_GYNECOLOGIE"), ("M", "ORL"), ("E", "ORL")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string")
    out = [r.y for r in df.select("i", labels.broad_category(F.col("t"), F.col("c")).alias("y")).orderBy("i").collect()]
    assert out == ["Pediatrie", "Medical", "Trauma", "Maternite/Gynecologie", "Maternite/Gynecologie", "Medical"]


def test_dimensions(spark):
    assert labels.diagnosis_table(spark).count() == 26
    assert len(labels.PLAUSIBLE_DIAGNOSES) == 18
    coded = labels.with_codes(spark.createDataFrame([("TRAUMA",), ("ORL",)], "diagnostic_categorie string"))
    found = {r.diagnostic_categorie: r.icd11 for r in coded.collect()}
    assert found == {"TRAUMA": "NE60-NF07 (Injury, poisoning)", "ORL": None}


def test_names(spark):
    given = ["", "awa diop", "tymczak", "pfister", "1abc", "ashcraft", "honeyman"]
    assert apply(spark, similarity.block_key, given) == ["", "A000", "T522", "P236", "1120", "A261", "H555"]
    keys = spark.createDataFrame([("Aïssa ", None), (None, "Diop Fall")], "p string, n string")
    key = labels.full_name_key(labels.name_key(F.col("p")), labels.name_key(F.col("n")))
    assert [r[0] for r in keys.select(key).collect()] == ["aissa", "diopfall"]


def test_day_gap(spark):
    d = dt.datetime
    df = spark.createDataFrame([(d(2023, 9, 1, 10), d(2023, 9, 1, 11))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(similarity.day_gap(F.col("a"), F.col("b")), similarity.day_gap(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (1, 0)


def _random_names(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcd ", k=rng.randint(0, 14))) for _ in range(n)]


def test_jaro_winkler_against_duckdb():
    left, right = _random_names(4000, 3), _random_names(4000, 4)
    right[:500] = [x[:3] + y for x, y in zip(left[:500], right[:500])]
    ours = similarity.jaro_winkler_values(left, right)
    con = duckdb.connect()
    import pandas as pd

    pairs = pd.DataFrame({"i": range(len(left)), "l": left, "r": right})
    con.register("pairs", pairs)
    theirs = con.execute("select jaro_winkler_similarity(l, r) from pairs order by i").fetchall()
    for mine, (other,), l, r in zip(ours, theirs, left, right):
        if l or r:
            assert mine == pytest.approx(other, abs=1e-12), (l, r)


def test_jaro_winkler_is_symmetric():
    left, right = _random_names(20000, 5), _random_names(20000, 6)
    one = similarity.jaro_winkler_values(left, right)
    two = similarity.jaro_winkler_values(right, left)
    assert abs(one - two).max() < 1e-12


def test_round_half_even(spark):
    assert apply(spark, lambda c: text.round_half_even(c, 1), [0.25, 0.75, 2.0], "double") == [0.2, 0.8, 2.0]
    assert apply(spark, text.round_half_even, [0.5, 1.5, -2.5], "double") == [0.0, 2.0, -2.0]
