"""Name similarity: phonetic key, Jaro-Winkler, score and day distance."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the function below by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weights of name, age and date in the score, age tolerance,
# Jaro-Winkler prefix weight, prefix length and the floor of its bonus.
NAME_WEIGHT, AGE_WEIGHT, DATE_WEIGHT = 0.7, 0.2, 0.1
AGE_TOLERANCE, DAY_TOLERANCE = 2, 1
PREFIX_WEIGHT, PREFIX_LENGTH, BONUS_FLOOR = 0.1, 4, 0.7

MICROS_PER_DAY = 86_400_000_000
_CELLS_PER_CHUNK = 4_000_000


def block_key(name: Column) -> Column:
    """Soundex of the first word; '' for an empty name.

    Spark returns a word that starts with a digit unchanged, so the digit is
    kept and the rest coded behind a vowel, which carries no code of its own.
    """
    word = F.split(name, " ", 2)[0]
    after_digit = F.substring(F.soundex(F.concat(F.lit("a"), F.substr(word, F.lit(2)))), 2, 3)
    return F.when(
        word.rlike("^[0-9]"), F.concat(F.substring(word, 1, 1), after_digit)
    ).otherwise(F.soundex(word))


def wall_micros(moment: Column) -> Column:
    """Microseconds on the wall clock since 1970, whatever the session zone."""
    days = F.unix_date(F.to_date(moment)).cast("bigint")
    minutes = days * 1440 + F.hour(moment) * 60 + F.minute(moment)
    seconds = F.extract(F.lit("SECOND"), moment)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def micros_gap(earlier: Column, later: Column) -> Column:
    """Whole days between two microsecond counts, floored before the sign goes."""
    return F.abs(F.floor((earlier - later) / F.lit(MICROS_PER_DAY))).cast("bigint")


def day_gap(earlier: Column, later: Column) -> Column:
    """Whole days between two moments, the earlier visit first."""
    return micros_gap(wall_micros(earlier), wall_micros(later))


def age_score(gap: Column) -> Column:
    return 1 - F.least(gap / F.lit(float(AGE_TOLERANCE)), F.lit(1.0))


def composite(similarity: Column, age_part: Column, date_part: Column) -> Column:
    return (
        F.lit(NAME_WEIGHT) * similarity
        + F.lit(AGE_WEIGHT) * age_part
        + F.lit(DATE_WEIGHT) * date_part
    )


def composite_value(similarity: float, age_part: float, date_part: float) -> float:
    return (
        NAME_WEIGHT * similarity + AGE_WEIGHT * age_part + DATE_WEIGHT * date_part
    )


def _code_matrix(words: list[str], width: int, filler: int) -> np.ndarray:
    joined = "".join(w.ljust(width, "\0") for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.int32)
    codes = codes.reshape(len(words), width).copy()
    lengths = np.array([len(w) for w in words])
    codes[np.arange(width)[None, :] >= lengths[:, None]] = filler
    return codes


def _jaro_winkler_chunk(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of word pairs; every step works on all pairs at once."""
    n = len(left)
    la = np.array([len(w) for w in left])
    lb = np.array([len(w) for w in right])
    width = max(int(la.max()), int(lb.max()), 1)
    a = _code_matrix(left, width, -1)
    b = _code_matrix(right, width, -2)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a = np.zeros((n, width), dtype=bool)
    used_b = np.zeros((n, width), dtype=bool)
    widest = int(reach.max())
    for i in range(width):
        open_pair = i < la
        for j in range(max(0, i - widest), min(width, i + widest + 1)):
            hit = (
                open_pair
                & (a[:, i] == b[:, j])
                & ~used_b[:, j]
                & (np.abs(i - j) <= reach)
            )
            used_b[hit, j] = True
            used_a[hit, i] = True
            open_pair &= ~hit
    matched = used_a.sum(axis=1)
    # Stable sorting puts the matched characters first, in their own order.
    rows = np.arange(n)[:, None]
    seq_a = a[rows, np.argsort(~used_a, axis=1, kind="stable")]
    seq_b = b[rows, np.argsort(~used_b, axis=1, kind="stable")]
    counted = np.arange(width)[None, :] < matched[:, None]
    swaps = ((seq_a != seq_b) & counted).sum(axis=1) // 2
    safe = np.maximum(matched, 1)
    jaro = (matched / np.maximum(la, 1) + matched / np.maximum(lb, 1) + (matched - swaps) / safe) / 3.0
    jaro = np.where(matched == 0, 0.0, jaro)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    head = min(PREFIX_LENGTH, width)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    bonus = prefix * PREFIX_WEIGHT * (1.0 - jaro)
    return np.where(jaro > BONUS_FLOOR, jaro + bonus, jaro)


def jaro_winkler_values(left: list[str], right: list[str]) -> np.ndarray:
    """Similarities in input order, computed in chunks of like word length."""
    out = np.zeros(len(left))
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(left, right)])
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(order):
        # Widths ascend, so the chunk's last row sets its matrix width.
        end = start + 1
        while (
            end < len(order)
            and (end + 1 - start) * longest[order[end]] <= _CELLS_PER_CHUNK
            and longest[order[end]] <= 2 * longest[order[start]] + 8
        ):
            end += 1
        part = order[start:end]
        out[part] = _jaro_winkler_chunk([left[i] for i in part], [right[i] for i in part])
        start = end
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; a pair repeated in the batch is scored once."""
    pairs = pd.DataFrame({"l": left.to_numpy(), "r": right.to_numpy()})
    known = pairs.notna().all(axis=1)
    distinct = pairs[known].drop_duplicates()
    if distinct.empty:
        return pd.Series(np.full(len(pairs), np.nan))
    distinct["s"] = jaro_winkler_values(list(distinct["l"]), list(distinct["r"]))
    return pairs.merge(distinct, on=["l", "r"], how="left")["s"]
