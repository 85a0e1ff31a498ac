"""Typing expressions: ages, dates, codes, calendar parts, age bands."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edge and label of each age band; each ends at the next edge.
AGE_BANDS = (
    (0, "0-4"),
    (5, "5-14"),
    (15, "15-24"),
    (25, "25-39"),
    (40, "40-59"),
    (60, "60-74"),
    (75, "75+"),
)
AGE_MIN, AGE_MAX = 0, 120


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    """Decimal digits of other scripts in the basic plane and their ASCII form."""
    pairs = [
        (chr(code), str(unicodedata.decimal(chr(code))))
        for code in range(0x80, 0x10000)
        if unicodedata.category(chr(code)) == "Nd"
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def age_from_text(text: Column) -> Column:
    """First run of one to three digits, kept when it is a plausible age."""
    digits = F.regexp_extract(F.translate(text, *_digit_tables()), "([0-9]{1,3})", 1)
    age = F.nullif(digits, F.lit("")).cast("int")
    return F.when(age.between(AGE_MIN, AGE_MAX), age)


# How a real time is written as text; it is never turned around.
TYPED_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_TYPED = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = (
    r"((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
    r"oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))"
)
_WEEKDAY = r"(?:(?i:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?i:day)?[,.]?\s+)?"
_SEP, _YEAR = r"[/.\-]", r"(\d{4}|\d{2})"
# One alternation for all layouts; the comments name the groups.
_LAYOUTS = (
    rf"(\d{{4}})(?:{_SEP}(\d{{1,2}})(?:{_SEP}(\d{{1,2}}))?)?",  # 1 year, 2 month, 3 day
    r"((?:19|20)\d\d)(0[1-9]|1[0-2])(\d\d)",  # 4 year, 5 month, 6 day
    rf"(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YEAR}",  # 7 day, 8 month, 9 year
    rf"(\d{{1,2}}){_SEP}(\d{{4}})",  # 10 month, 11 year
    rf"(\d{{1,2}})[ /.\-]*{_NAME}[ /.,\-]+{_YEAR}",  # 12 day, 13 name, 14 year
    rf"{_NAME}[ /.,\-]+(\d{{4}})",  # 15 name, 16 year
    rf"{_NAME}[ /.\-]+(\d{{1,2}})[ ,/.\-]+{_YEAR}",  # 17 name, 18 day, 19 year
)
_CLOCK = (
    r"[ T]+(?:(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"  # 20 hour, 21 minute, 22 second, 23 fraction, 24 half
    r"|(\d\d)(\d\d)(\d\d)?)"  # 25 hour, 26 minute, 27 second
    r"(?:\s*([Zz]|UTC|GMT|[+\-]\d{2}(?::?\d{2})?))?"  # 28 zone
)
_WRITTEN = rf"^\s*{_WEEKDAY}(?:{'|'.join(_LAYOUTS)})(?:{_CLOCK})?\s*$"
_MARK = "\u0001"
_FIELDS = ("year", "month", "name", "day", "hour", "minute", "second", "fraction", "half", "zone", "year_first")
_PARTS = _MARK + "|$1$4$9$11$14$16$19|$2$5$8$10|$13$15$17|$3$6$7$12$18|$20$25|$21$26|$22$27|$23|$24|$28|$1"
_LAST_SHORT_YEAR = 68  # two-digit years: 00 to 68 are of this century, as in POSIX


def parse_entry_date(text: Column, iso_day_first: bool = False, to_utc: bool = False) -> Column:
    """Timestamp without zone from day-first or ISO text; unreadable gives NULL.

    Reads d/m/y with two or four digits of the year, y-m-d, yyyymmdd, and
    English month names (3 Sep 2023, September 3, 2023), each after a weekday
    name and with a clock of 12 or 24 hours if there is one (10:11:12.5, 10h30,
    101112). Fractions of a second are kept to the microsecond. A month or a
    year alone is its first day. The result is the clock as written;
    ``to_utc`` takes a written zone's offset off.

    A text whose month cannot be one is read with day and month exchanged.
    ``iso_day_first`` reads ``2023-09-03`` as 9 March. Text that was a real
    time (see ``TYPED_TIME``) is never turned around.
    """
    # All layouts are tried in one pass, which leaves the parts side by side.
    marked = F.when(~F.contains(text, F.lit(_MARK)), F.regexp_replace(text, _WRITTEN, _PARTS))
    return F.element_at(F.transform(F.array(F.split(marked, r"\|", -1)), lambda p: _moment(text, p, iso_day_first, to_utc)), 1)


def _moment(text: Column, parts: Column, iso_day_first: bool, to_utc: bool) -> Column:
    of = {name: F.get(parts, F.lit(i + 1)) for i, name in enumerate(_FIELDS)}
    number = {name: F.try_element_at(parts, F.lit(_FIELDS.index(name) + 2)) for name in _FIELDS}
    number = {name: F.nullif(value, F.lit("")).try_cast("int") for name, value in number.items()}
    one, zero = F.lit(1), F.lit(0)
    century = F.when(F.length(of["year"]) > 2, 0).when(number["year"] <= _LAST_SHORT_YEAR, 2000).otherwise(1900)
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(of["name"], 1, 3))).cast("int")
    month = F.when(of["name"] != "", named).otherwise(F.coalesce(number["month"], one))
    day = F.coalesce(number["day"], one)
    turned = (month > 12) & (number["day"] <= 12)
    if iso_day_first:
        whole = (of["year_first"] != "") & number["day"].isNotNull() & ~text.rlike(_TYPED)
        turned = F.when(whole, ~((day > 12) & (month <= 12))).otherwise(turned)
    hour, half = F.coalesce(number["hour"], zero), F.lower(of["half"])
    hour = F.when(half == "", hour).when(hour <= 12, hour % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.concat(F.coalesce(number["second"], zero), F.lit("."), F.rpad(F.substring(of["fraction"], 1, 6), 6, "0"))
    moment = F.try_make_timestamp_ntz(
        number["year"] + century, F.when(turned, day).otherwise(month), F.when(turned, month).otherwise(day),
        hour, F.coalesce(number["minute"], zero), seconds.cast("decimal(8,6)"),
    )
    if to_utc:
        digits = F.rpad(F.regexp_replace(F.substring(of["zone"], 2, 5), ":", ""), 4, "0")
        minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
        sign = F.substring(of["zone"], 1, 1)
        offset = F.when(sign == "+", minutes).when(sign == "-", -minutes).otherwise(zero)
        moment = F.timestamp_add("MINUTE", -offset, moment).cast("timestamp_ntz")
    return F.when(F.get(parts, F.lit(0)) == _MARK, moment)


def patient_type_code(answer: Column) -> Column:
    """Leading U, E, P or M of the code answer, any case."""
    return F.nullif(F.regexp_extract(F.upper(answer), r"^\s*([UEPM])", 1), F.lit(""))


def weekday_name(moment: Column) -> Column:
    return F.date_format(moment, "EEEE")


def age_band(age: Column) -> Column:
    """Label of the band holding ``age``; NULL below the first edge."""
    label = F.lit(None).cast("string")
    for edge, name in AGE_BANDS:
        label = F.when(age >= edge, F.lit(name)).otherwise(label)
    return label


def age_band_order(age: Column) -> Column:
    """Position of the band, for sorting."""
    position = F.lit(None).cast("int")
    for index, (edge, _) in enumerate(AGE_BANDS):
        position = F.when(age >= edge, F.lit(index)).otherwise(position)
    return position
