"""Personal data: fixed patterns, and weakly supervised spans around them.

Candidate spans come from the fixed patterns of each kind and from wider ones:
mail addresses with "at" and "dot" in words or brackets, addresses with
bracketed dots, cards and phone numbers in other groupings. Labelers vote on
each: the pattern's own checks (regex), known endings, country codes and issuer
digits (gazetteer), the words before the span (context), how it is written
(form), and what stands right before it (neighbour). Expectation-maximisation
over the counts of vote patterns estimates, apart for fixed and wide candidates
of each kind, how reliable each labeler is and how likely each candidate is
real; a logistic span classifier is trained on those likelihoods, with votes and
shape as features. Spans of the fixed patterns always stay; the classifier
decides about the wide ones.

Only counts per vote pattern (a bounded number) reach the driver. Positions
count code points. Every expression runs in the JVM, and the work on a text is
in proportion to its length and its matches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import fresh, let, running, staged

KINDS = ("email", "ip", "card", "phone")
# Possessive runs and the look-behind keep long runs linear. They match where
# the plain patterns do: a run that fails at its start fails at all later
# places too, except after a match that ended inside it (\G). A card needs 14
# digits; a shorter run of digits holds no longer one, so it is not matched.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOT = r"(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))"
GROUP = r"(?:[./_] ?|  |, )"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?: ?{DOT} ?[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": rf"(?<![0-9])[0-9]{{4}}(?:{GROUP}[0-9]{{4}}){{2}}{GROUP}[0-9]{{1,7}}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]?(?:[ .-][0-9]{2,5}){2,5})(?![0-9-])",
}
# A text without these has no match of the pattern; looking for them is cheap.
NEEDS = {("email", True): ("@",), ("phone", True): ("+",), ("email", False): (" at ", "(at)", "[at]"), ("ip", False): (".]", ".)", "dot]", "dot)")}
# Fixed values of the labelers.
CONTEXT = {
    "email": r"mail|contact|write|reply|kontakt|correo|courriel",
    "ip": r"ip|host|server|address|adresse|login",
    "card": r"card|visa|master|amex|karte|carte|tarjeta|credit|pay",
    "phone": r"phone|tel|call|mobile|fax|cell|contact|ruf|appel|llam",
}
AGAINST = r"version|order|invoice|isbn|article|page|ticket|serial|chapter|section|part|model|figure|score"
ENDINGS = r"(?:\.|dot\)|dot\]|dot) ?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
COUNTRIES = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
AREA = r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
# Written as such data is written, or not.
FORM = {
    ("email", True): (r"^[A-Za-z0-9]", r"^[._%+-]"),
    ("email", False): (r"[(\[]at[)\]]| at [^.]* dot |^[^ A-Z]+ at [a-z0-9-]+(?:\.[a-z0-9-]+)+$", r" at .*(?:\. | \.|\.[A-Z])"),
    ("ip", True): (r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$", r"(?:^|\.)0[0-9]"),
    ("ip", False): (r"^[0-9]+([^0-9]+)[0-9]+\1[0-9]+\1[0-9]+$", r"(?:^|[^0-9])0[0-9]"),
    ("card", True): (r"^(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$", r"[ -][0-9][ -]"),
    ("card", False): (r"^[0-9]{4}([^0-9]+)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", r"[^0-9][0-9]{1,2}$|[^0-9][0-9]{5,}$"),
    ("phone", True): (r"^\+[0-9]+[ (.-]", r"\.\.|--|  "),
    ("phone", False): (r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|00[0-9 .-]+)$", r"^\([0-9]{3}[ .-]|^[0-9]{3}\)|^[0-9]{3}([ .-])[0-9]{3}(?!\1)[ .-]"),
}
NEXT_TO = r"(?:[:=(]|\b(?:is|me|us|at|on|to|or|unter|est|al|por))\s*$|@|\+[0-9]"
NOT_NEXT_TO = r"(?:[#$€£%/]|\b(?:no|nr|id|v|rev|ref|vol)\b[.:]?)\s*$"
VOTERS = ("regex", "gazetteer", "context", "form", "neighbour")
BEFORE = 24


SPAN = "struct<start:int,kind:int,end:int,match:string,before:string>"


def spans_of(text: Column, pattern: str, kind: int, needs: tuple[str, ...] = ()) -> Column:
    """Non-overlapping matches as structs of start, kind, end, match and the text before.

    The gaps between the matches of a pattern are what a split at it leaves, so
    positions are running sums of gap and match lengths. Texts that hold none
    of ``needs`` are not searched.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(matches: Column, gaps: Column) -> Column:
        lengths = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        at = F.zip_with(running(lengths, lambda x, y: x + y, "int"), matches, lambda e, m: F.struct(e.alias("end"), m.alias("match")))
        return F.zip_with(at, gaps, lambda s, g: F.struct(
            (s["end"] - F.length(s["match"])).alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
            s["match"].alias("match"), F.lower(F.substring(g, -BEFORE, BEFORE)).alias("before"),
        ).cast(SPAN))

    def found(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return F.when(F.size(matches) == 0, none).otherwise(let(gaps, lambda g: placed(matches, g)))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    if not needs:
        return spans
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needs]), spans).otherwise(none)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check that a match of a fixed pattern has to pass."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def checked(kind: str, base: bool, match: Column) -> Column:
    """Vote of the pattern's own checks; for wide spans only where there is one."""
    if base:
        return F.when(valid(kind, match), 1).otherwise(-1)
    if kind == "card":
        return F.when(F.length(digits(match)).between(14, 19) & luhn(digits(match)), 1).otherwise(-1)
    if kind == "ip":
        numbers = F.regexp_replace(match, "[^0-9]+", ".")
        return F.when(valid("ip", numbers), 1).otherwise(-1)
    return F.lit(0)


def votes(kind: str, span: Column, base: bool) -> Column:
    """Votes of the labelers (1 real, -1 not, 0 no opinion) and a shape bucket."""
    match, before = span["match"], span["before"]
    # Endings and forms are looked for in a bounded part of a match.
    head, tail = F.substring(match, 1, 80), F.substring(match, -80, 80)
    known = {
        "email": F.regexp_like(F.lower(tail), F.lit(ENDINGS)),
        "ip": ~F.regexp_like(match, F.lit(r"^0*(?:0|127|255)(?![0-9])")),
        "card": F.regexp_like(digits(head), F.lit(ISSUERS)),
        "phone": F.regexp_like(match, F.lit(COUNTRIES if base else f"{COUNTRIES}|{AREA}")),
    }[kind]
    context = F.when(F.regexp_like(before, F.lit(AGAINST)), -1).when(F.regexp_like(before, F.lit(CONTEXT[kind])), 1).otherwise(0)
    good, bad = FORM[kind, base]
    form = F.when(F.regexp_like(head, F.lit(bad)), -1).when(F.regexp_like(head, F.lit(good)), 1).otherwise(0)
    near = F.when(F.regexp_like(before, F.lit(NOT_NEXT_TO)), -1).when(F.regexp_like(before, F.lit(NEXT_TO)), 1).otherwise(0)
    shape = F.least(F.lit(3), (F.length(match) / 8).cast("int"))
    each = (checked(kind, base, match), F.when(known, 1).otherwise(-1), context, form, near)
    return F.struct(*[v.alias(name) for name, v in zip(VOTERS, each)], shape.alias("shape"))


def candidates(text: Column) -> Column:
    """Valid fixed spans and all other candidates of a text, with their votes."""

    def judged(kind: str, base: bool):
        def one(s: Column) -> Column:
            return let(votes(kind, s, base), lambda v: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                ((v["regex"] == 1) if base else F.lit(False)).alias("base"), F.lit(base).alias("fixed"), v.alias("votes"),
            ))

        return one

    groups = [
        F.transform(spans_of(text, patterns[kind], number, NEEDS.get((kind, base), ())), judged(kind, base))
        for number, kind in enumerate(KINDS)
        for base, patterns in ((True, BASE), (False, WIDE))
    ]
    return F.concat(*groups)


# Log odds that a vote of 1, or of -1, is taken to speak for before any is
# weighed: failed checks and words against say much, a fitting ending little.
FIRST_ODDS = {"regex": (2.2, -4.0), "gazetteer": (0.4, -0.8), "context": (1.7, -3.0), "form": (0.6, -1.7), "neighbour": (1.1, -2.2)}


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, tuple[int, ...]], float]:
    """Likelihood that a candidate is real, per kind and vote pattern, by expectation-maximisation.

    ``counts`` holds kind, votes (in the order of ``VOTERS``) and number of
    candidates; a kind here stands for a group that is judged apart. Labelers
    are taken as independent given the truth; their rates are smoothed by one
    count, and the first guess follows ``FIRST_ODDS``.
    """
    first = list(FIRST_ODDS.values())
    out = {}
    for kind in {k for k, _, _ in counts}:
        mine = [(v, n) for k, v, n in counts if k == kind]
        truth = {v: 1 / (1 + math.exp(-sum(f[x < 0] if x else 0.0 for f, x in zip(first, v)))) for v, _ in mine}
        for _ in range(rounds):
            total = [sum(n * (t if real else 1 - t) for v, n in mine for t in [truth[v]]) + 1 for real in (0, 1)]
            rate = [
                [{x: (sum(n * (truth[v] if real else 1 - truth[v]) for v, n in mine if v[j] == x) + 1) / (total[real] + 2) for x in (-1, 0, 1)}
                 for j in range(len(mine[0][0]))]
                for real in (0, 1)
            ]
            for v, _ in mine:
                odds = math.log(total[1]) - math.log(total[0]) + sum(math.log(rate[1][j][x] / rate[0][j][x]) for j, x in enumerate(v))
                truth[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): t for v, t in truth.items()}
    return out


def classifier(rows: list[tuple[int, tuple[int, ...], int, int]]) -> dict[tuple, float]:
    """Weights of a logistic span classifier trained on the likelihoods.

    ``rows`` holds kind, votes, shape and number of candidates. Features are
    the kind and, per kind, each vote and the shape.
    """
    counts: dict[tuple, int] = {}
    for kind, v, _, n in rows:
        counts[kind, v] = counts.get((kind, v), 0) + n
    truth = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    total = sum(n for *_, n in rows) or 1
    data = [
        ([("kind", k), *[("vote", k, j, x) for j, x in enumerate(v)], ("shape", k, s)], truth[k, v], n / total)
        for k, v, s, n in rows
    ]
    weight = {f: 0.0 for fs, _, _ in data for f in fs}
    for _ in range(400):
        slope = {f: 1e-3 * w for f, w in weight.items()}
        for fs, t, share in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in fs)))))
            for f in fs:
                slope[f] += share * (p - t)
        for f, s in slope.items():
            weight[f] -= 2.0 * s
    return weight


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap no span of ``base``, in order.

    All are met in one order: a span of ``base`` at its start, one of ``more``
    at its end. It is free if no base span before it reaches past its start.
    """
    event = lambda at, own, s: F.struct(at.alias("at"), F.lit(own).alias("own"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    events = F.sort_array(F.concat(
        F.transform(more, lambda s: event(s["end"], 0, s)), F.transform(base, lambda s: event(s["start"], 1, s))
    ))

    def free(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: F.when(x["own"] == 1, x["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), "int")
        told = F.zip_with(e, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
        return F.transform(F.filter(told, lambda t: (t["x"]["own"] == 0) & (t["r"] <= t["x"]["start"])), lambda t: plain(t["x"]))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), F.transform(more, plain)).otherwise(let(events, free))


def plain(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def detect(docs: DataFrame, text: Column, *, least: float = 0.5, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the spans of personal data to rows.

    Returns ``row`` (struct of the input columns, or of those in ``carry``),
    ``base`` and ``spans``: arrays of structs (start, kind, end), in order;
    ``kind`` is a place in ``KINDS``. Null texts count as empty. Spans of
    different kinds may overlap; of one kind fixed spans never do, and added
    spans overlap no fixed one.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)])
    found = staged(docs.select(row.alias("row"), candidates(F.coalesce(text, F.lit(""))).alias("found")), "pii-candidates")
    group = (F.col("s.kind") * 2 + F.when(F.col("s.fixed"), 0).otherwise(1)).alias("group")
    seen = found.select(F.explode("found").alias("s")).groupBy(group, "s.votes").count().collect()
    weight = classifier(sorted((r["group"], tuple(r["votes"][v] for v in VOTERS), r["votes"]["shape"], r["count"]) for r in seen))

    def score(s: Column) -> Column:
        total = F.lit(0.0)
        for f, w in sorted(weight.items(), key=str):
            if f[1] % 2 == 1:  # only wide spans are scored
                here = s["kind"] == f[1] // 2
                if f[0] == "vote":
                    here = here & (s["votes"][VOTERS[f[2]]] == f[3])
                elif f[0] == "shape":
                    here = here & (s["votes"]["shape"] == f[2])
                total = total + F.when(here, F.lit(w)).otherwise(0.0)
        return total

    cut = math.log(least / (1 - least))
    base = F.transform(F.filter("found", lambda s: s["base"]), plain)
    more = F.filter("found", lambda s: F.when(s["fixed"], F.lit(False)).otherwise(score(s) >= cut))
    with_base = found.select("row", F.sort_array(base).alias("base"), F.transform(more, plain).alias("more"))
    return with_base.select("row", "base", F.sort_array(F.concat("base", apart(F.col("more"), F.col("base")))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


# Texts whose length times number of spans is beyond this are cut letter by letter.
LETTERS_BEYOND = 4_000_000


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are merged.

    ``spans`` are in order. A span that starts before an earlier one has ended
    is no mark of its own; the text goes on where the furthest has ended.
    """

    def marked(s: Column, cut) -> Column:
        ends = running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y), "int")
        before = lambda e: F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1))
        told = let(ends, lambda e: F.zip_with(F.zip_with(s, before(e), lambda x, b: F.struct(x.alias("x"), b.alias("b"))), e, lambda t, n: F.struct(
            t["x"].alias("x"), t["b"].alias("b"), n.alias("n"))))
        parts = F.transform(F.filter(told, lambda t: t["x"]["start"] >= t["b"]), lambda t: F.concat(
            cut(t["b"], t["x"]["start"] - t["b"]), F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), t["x"]["kind"] + 1), F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

    by_place = lambda s: marked(s, lambda at, n: F.substr(text, at + 1, n))
    by_letter = lambda s: let(F.split(text, ""), lambda c: marked(s, lambda at, n: F.array_join(F.slice(c, at + 1, n), "")))
    large = F.length(text).cast("long") * F.size(spans) > LETTERS_BEYOND
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda s: F.when(large, by_letter(s)).otherwise(by_place(s))))


def mask(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with personal data in ``column`` masked; all other columns as they are."""
    spans = fresh("spans")
    found = detect(docs, docs[f"`{column}`"]).select("row.*", F.col("spans").alias(spans))
    return found.withColumn(column, masked(F.col(f"`{column}`"), F.col(spans))).drop(spans)


def query(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    found = detect(docs, F.col("text"), carry=("doc_id",))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
