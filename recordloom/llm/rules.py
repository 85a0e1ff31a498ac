"""Quality rules: counts of a text, and its divergence from language references.

A document passes if its base counts pass and its histograms of character
classes and common words lie near those of at least one language. References
are the mean histograms of all documents of a language; nearness is the
Jensen-Shannon distance (square root of the divergence in bits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import SPACE, staged, words

# Frequent words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "den"),
    "fr": ("le", "la", "de", "et", "les", "des", "est", "que"),
    "es": ("el", "los", "en", "y", "por", "una", "con", "se"),
}
# Capitals, digits and punctuation; the other classes are white space, symbols, other scripts and the rest.
MARKS = r"[A-Z0-9.,;:!?'\"()-]"
SYMBOLS = r"[#*$%&|<>]"


def windows(tokens: Column, width: int) -> Column:
    """A hash for every run of ``width`` words; needs an array of word hashes."""
    grams = F.transform(tokens, lambda x, i: F.xxhash64(x, *[F.get(tokens, i + k) for k in range(1, width)]))
    return F.slice(grams, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - (width - 1)))


def covered(grams: Column, width: int) -> Column:
    """Words that lie in a window found twice or more.

    Windows are sorted with their place; a window with an equal neighbour is a
    repeated one. Windows of equal hash stand together, places ascending.
    """
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        twin = lambda x, i: ((i > 0) & (F.get(p, i - 1)["g"] == x["g"])) | (
            (i < F.size(p) - 1) & (F.get(p, i + 1)["g"] == x["g"])
        )
        return F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))

    def total(places: Column) -> Column:
        steps = F.transform(
            places, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - x, F.lit(width)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # let-bindings: each array is built once although it is used several times
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return F.when(
        F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)
    ).otherwise(bound(pairs, lambda p: bound(repeated(p), total))).cast("long")


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds the counts of the base rules to rows with ``text`` and ``words``."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    return (
        rows.withColumn("lines", lines)
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("grams", windows(F.col("hashes"), 5))
        .select(
            "row",
            "text",
            "words",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered(F.col("grams"), 5).alias("n_repeat_words"),
        )
    )


def histograms(counted: DataFrame) -> DataFrame:
    """Adds ``classes`` and ``commons``, arrays of counts; the text goes."""
    vocabulary = [w for ws in COMMON.values() for w in ws]
    length = F.length("text")
    spaces = length - F.col("word_chars")
    foreign = F.octet_length("text") - length
    classes = [F.regexp_count("text", F.lit(MARKS)), spaces, F.col("n_symbols"), foreign]
    rest = F.greatest(F.lit(0), length - sum(classes[1:], classes[0]))
    found = F.filter("words", lambda w: w.isin(*vocabulary, *map(str.capitalize, vocabulary), *map(str.upper, vocabulary)))
    lower = F.transform(found, lambda w: F.lower(w))
    commons = [F.size("found") - F.size(F.array_remove("found", w)) for w in vocabulary]
    return counted.withColumn("found", lower).select(
        *[c for c in counted.columns if c not in ("text", "words")],
        F.array(*[c.cast("double") for c in [*classes, rest]]).alias("classes"),
        F.array(*[c.cast("double") for c in [*commons, F.col("n_words") - F.size("found")]]).alias("commons"),
    )


def references(counted: DataFrame, lang: Column) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of every known language: one row per language, four at most.

    Each document weighs the same, so a long one of noise changes little. Every
    class gets a small share, so that no reference holds a zero.
    """
    sizes = {"classes": 5, "commons": sum(map(len, COMMON.values())) + 1}
    total = {c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x) for c in sizes}
    shares = counted.where(lang.isin(*COMMON) & (F.col("n_words") > 0)).select(
        lang.alias("lang"), *sizes, *[t.alias(f"{c}_total") for c, t in total.items()],
    )
    sums = [F.sum(F.get(c, F.lit(i)) / F.col(f"{c}_total")).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    rows = shares.groupBy("lang").agg(*sums).collect()
    out = {}
    for row in sorted(rows, key=lambda r: r["lang"]):
        parts = []
        for c, n in sizes.items():
            shares_ = [row[f"{c}{i}"] + 1e-3 for i in range(n)]
            parts.append([x / sum(shares_) for x in shares_])
        out[row["lang"]] = tuple(parts)
    return out


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (0 to 1) of a count array from a reference."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    ref = F.array(*[F.lit(x) for x in reference])

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, ref, lambda x, q: part(x / total, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(
    docs: DataFrame,
    text: Column,
    lang: Column,
    *,
    min_words: int = 50,
    max_classes: float = 0.22,
    max_commons: float = 0.30,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Counts, distances and verdict of every row.

    Returns ``row`` (struct of all input columns), ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``class_distance`` and
    ``word_distance`` (to the nearest language; null below ``min_words``),
    ``base_failed`` and ``kept``.

    ``carry`` names the input columns that ``row`` shall hold, all by default.

    Null and blank texts have no words and fail the base rule. Texts under
    ``min_words`` are judged by the base rule alone. Rows of unknown or null
    language are compared with every language, but feed no reference. Without
    any known language the base rule alone decides.
    """
    kept = F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)])
    rows = docs.select(
        F.struct(kept.alias("row"), lang.alias("lang")).alias("row"),
        F.coalesce(text, F.lit("")).alias("text"),
        words(text).alias("words"),
    )
    counted = staged(histograms(base_counts(rows)), "rule-counts")
    known = references(counted, F.col("row.lang"))
    near = lambda c, k: F.least(*d) if len(d := [distance(F.col(c), r[k]) for r in known.values()]) > 1 else d[0] if d else F.lit(None)
    long_enough = F.col("n_words") >= min_words
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.select(
        F.col("row.row").alias("row"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(long_enough, near("classes", 0)).cast("double").alias("class_distance"),
        F.when(long_enough, near("commons", 1)).cast("double").alias("word_distance"),
        failed.alias("base_failed"),
    )
    fine = F.coalesce((F.col("class_distance") <= max_classes) & (F.col("word_distance") <= max_commons), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fine)


def query(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(docs.select("doc_id", "text", "lang"), F.col("text"), F.col("lang"), carry=("doc_id",)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )
