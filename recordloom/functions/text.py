"""Text expressions: encoding repair, cleaning, canonical keys, rounding."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that betray text decoded with the wrong code page.
ENCODING_MARKERS = "ÈË‡¬ÔÁÇÊœÕ"

# Escapes left in cells by spreadsheet export.
CELL_ESCAPES = (("_x0019_", "’"), ("_x0013_", "-"))

@lru_cache(maxsize=1)
def encoding_tables() -> tuple[str, str, str]:
    """(source, target, encodable): the per-character form of the byte repair.

    Both code pages have one byte per character, so encoding with one and
    decoding with the other maps characters one to one. ``encodable`` lists the
    non-ASCII characters that survive the trip; any other character means the
    text has to stay as it is.
    """
    source, target, encodable = [], [], []
    for byte in range(0x80, 0x100):
        was = bytes([byte]).decode("mac_roman")
        try:
            now = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        encodable.append(was)
        if was != now:
            source.append(was)
            target.append(now)
    return "".join(source), "".join(target), "".join(encodable)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _holds_any(text: Column, chars: str) -> Column:
    """True if one of ``chars`` occurs; faster than a large character class."""
    return F.translate(text, chars, "") != text


def repair_encoding(text: Column) -> Column:
    """Undo Mac Roman bytes read as Windows text, where a marker shows it."""
    source, target, encodable = encoding_tables()
    repairable = ~_is_ascii(text) & _holds_any(text, ENCODING_MARKERS) & _is_ascii(F.translate(text, encodable, ""))
    return F.when(repairable, F.translate(text, source, target)).otherwise(text)


# White space in the basic plane other than the plain blank.
_ODD_SPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def _is_clean(text: Column) -> Column:
    """True where cleaning would change nothing; cheap, and true of most cells.

    Printable ASCII is told apart first.
    """
    return ~(
        (text.rlike(r"[^\x20-\x7e]") & _holds_any(text, ENCODING_MARKERS + _ODD_SPACE))
        | F.contains(text, F.lit("  "))
        | F.startswith(text, F.lit(" "))
        | F.endswith(text, F.lit(" "))
        | F.contains(text, F.lit("_x00"))
        | (text == "")
    )


def clean_text(text: Column, repair: bool = True) -> Column:
    """Repair, replace escapes, collapse white space; blank becomes NULL."""
    value = repair_encoding(text) if repair else text
    for escape, replacement in CELL_ESCAPES:
        value = F.replace(value, F.lit(escape), F.lit(replacement))
    value = F.translate(value, _ODD_SPACE, " " * len(_ODD_SPACE))
    value = F.trim(F.regexp_replace(value, " {2,}", " "))
    return F.when(_is_clean(text), text).otherwise(F.nullif(value, F.lit("")))


def _ascii_key(char: str) -> str:
    plain = unicodedata.normalize("NFKD", char)
    return "".join(c for c in plain if c.isascii() and c.isalnum()).lower()


# Blocks in which characters without a key are listed one by one for removal:
# Latin with its accents, combining marks, general punctuation and currency.
_LISTED_BLOCKS = (range(0x00, 0x250), range(0x300, 0x370), range(0x2000, 0x20D0))


@lru_cache(maxsize=1)
def slug_tables() -> tuple[str, str, dict[str, str]]:
    """(source, target, expanding) from the Unicode compatibility mappings.

    ``source[i]`` becomes ``target[i]``, or nothing beyond the end of
    ``target``; ``expanding`` holds the characters whose key is longer than one
    character or which lie beyond the basic plane.
    """
    source, target, expanding = [], [], {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        key = _ascii_key(char)
        if len(key) == 1 and code < 0x10000:
            source.append(char)
            target.append(key)
        elif key:
            expanding[char] = key
    dropped = [chr(c) for block in _LISTED_BLOCKS for c in block if not _ascii_key(chr(c))]
    return "".join(source + dropped), "".join(target), expanding


@lru_cache(maxsize=1)
def _expanding_ranges() -> str:
    """The characters with a longer key, as ranges of a character class."""
    codes = sorted(map(ord, slug_tables()[2]))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


def slug(text: Column) -> Column:
    """Key without accents, case, punctuation or spaces; NULL gives ''.

    ASCII texts only lose characters. For others one pass over a character
    table settles nearly all; what has no key, such as letters of other
    scripts, then goes at once. Only characters with a longer key are looked
    up one by one. The CASE evaluates a branch only where it is needed.
    """
    source, target, expanding = slug_tables()
    pairs = ",".join(f"{char}:{key}" for char, key in expanding.items())
    lookup = F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))
    ascii_noise = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
    by_table = F.translate(text, source, target)
    with_key = F.regexp_replace(by_table, f"[^a-zA-Z0-9{_expanding_ranges()}]+", "")
    spelled_out = F.array_join(
        F.transform(F.split(with_key, ""), lambda c: F.coalesce(F.try_element_at(lookup, c), c)), ""
    )
    general = F.regexp_replace(spelled_out, "[^a-zA-Z0-9]", "")
    key = (
        F.when(_is_ascii(text), F.translate(text, ascii_noise, ""))
        .when(~by_table.rlike("[^a-zA-Z0-9]"), by_table)
        .when(~with_key.rlike("[^a-zA-Z0-9]"), with_key)
        .otherwise(general)
    )
    return F.coalesce(F.lower(key), F.lit(""))


def attribute_category(attribute: Column) -> Column:
    """Part before the first colon; '' for a missing attribute."""
    return F.trim(F.split(F.coalesce(attribute, F.lit("")), ":", 2)[0])


def attribute_item(attribute: Column) -> Column:
    """Part after the first colon; NULL without a colon."""
    return F.trim(F.try_element_at(F.split(attribute, ":", 2), F.lit(2)))


def is_ticked(answer: Column) -> Column:
    """True for the answer of a ticked box."""
    return F.coalesce(F.lower(F.trim(answer)) == "on", F.lit(False))


def round_half_even(value: Column, places: int = 0) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    if places == 0:
        return F.rint(value)
    scale = float(10**places)
    return F.rint(value * scale) / scale
