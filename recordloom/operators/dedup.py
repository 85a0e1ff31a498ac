"""Removing likely duplicates: earlier visits win over later lookalikes.

Two visits of one year match when their names share a phonetic block, sex and
ages agree, dates are close and the score reaches the threshold. Going through
the visits in order, a visit is dropped if an earlier *kept* visit matches it.

The work never lists the pairs of a block:

* Visits equal in all compared fields form one class; only its first can stay.
* Classes of one name, sex, age and day form a cell. Where all members of a
  cell match each other, at most one of them stays.
* Pairs are formed between cells only, on equality of block, sex, age and day
  (shifted by the steps the threshold still allows), filtered by a bound on
  the similarity before the similarity itself is computed, and split into
  tiles where a key is crowded.
* The order rule is then solved in rounds over the cells still open.
* Crowded blocks are taken in phases, each several times the one before: what a
  kept visit of an earlier phase drops is found by a join with the kept visits
  alone, so pairs are listed only between visits none of these drops.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import similarity as sim
from ..functions.text import round_half_even
from ..session import few_rows_or_none, small_side, staged
from . import sweep as sweeping

THRESHOLD = 0.85
YEAR, ORDER, NAME = "annee", "visit_no", "nom_complet_norm"
# Rows of one join key handled by one tile; more rows mean more tiles.
TILE_ROWS = 4096
# Cells of one bucket of the order rule, and visits sent for each cell.
BUCKET_CELLS, SENT = 20_000, 8
# Classes of one year, block and sex in its first phase, and how much larger each later phase may be.
PHASE_CLASSES, PHASE_GROWTH = 50_000, 3
# Copies of the counts of crowded keys where these are too many to broadcast.
SALTS = 64
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_RANK_BUCKETS = 1024
_SLACK = 1e-9


@dataclass(frozen=True)
class Step:
    """A difference in age and day number at which two cells may still match."""

    ages: int
    days: int
    needed: float

    @property
    def jaro(self) -> float:
        """Lowest Jaro similarity that can still reach ``needed``."""
        if self.needed <= sim.BONUS_FLOOR:
            return self.needed
        top = sim.PREFIX_LENGTH * sim.PREFIX_WEIGHT
        return max(sim.BONUS_FLOOR, (self.needed - top) / (1 - top))


def _needed(threshold: float, ages: int, date_part: float) -> float:
    age_part = 1 - min(ages / sim.AGE_TOLERANCE, 1)
    return (threshold - sim.AGE_WEIGHT * age_part - sim.DATE_WEIGHT * date_part) / sim.NAME_WEIGHT


def allowed_steps(threshold: float) -> list[Step]:
    """Steps between dated cells, each unordered pair reachable once.

    Equal whole days need moments less than a day apart, so day numbers differ
    by at most one; a floored gap of one day allows two.
    """
    steps = []
    for ages in range(sim.AGE_TOLERANCE + 1):
        for days in range(-2, 3):
            if ages == 0 and days < 0:
                continue
            needed = _needed(threshold, ages, 1.0 if abs(days) <= 1 else 0.0)
            if needed <= 1 + _SLACK:
                steps.append(Step(ages, days, needed))
    return steps


def undated_steps(threshold: float) -> list[Step]:
    """Steps from an undated cell; a missing date never counts against a pair."""
    steps = [
        Step(ages, 0, _needed(threshold, abs(ages), 1.0))
        for ages in range(-sim.AGE_TOLERANCE, sim.AGE_TOLERANCE + 1)
    ]
    return [s for s in steps if s.needed <= 1 + _SLACK]


def cells_are_cliques(threshold: float) -> bool:
    """Whether equal name, sex, age and day are enough for a match."""
    return sim.composite_value(1.0, 1.0, 0.0) >= threshold


def comparable(df: DataFrame) -> Column:
    """Visits that can match any other; the gates look at raw age and sex."""
    return (df[NAME] != "") & df["sexe"].isNotNull() & df["age"].isNotNull()


def _compared(df: DataFrame) -> DataFrame:
    """The compared fields and the number of every comparable visit."""
    at = sim.wall_micros(F.col("date_entree")).alias("at")
    return df.filter(comparable(df)).select(YEAR, F.col(NAME).alias("name"), "sexe", "age", at, F.col(ORDER).alias("no"))


def match_classes(df: DataFrame) -> DataFrame:
    """One row per distinct set of compared fields: first visit and copies."""
    return (
        _compared(df)
        .groupBy(YEAR, "name", "sexe", "age", "at")
        .agg(F.min("no").alias("no"), F.count(F.lit(1)).alias("copies"))
    )


def _with_slot(classes: DataFrame, cliques: bool) -> DataFrame:
    day = F.floor(F.col("at") / F.lit(sim.MICROS_PER_DAY)).cast("bigint")
    return classes.withColumn("day", day).withColumn("slot", F.col("day") if cliques else F.col("at"))


def _letter_mask(name: Column) -> Column:
    bits = [F.when(F.contains(name, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(_LETTERS)]
    return reduce(lambda a, b: a + b, bits).cast("bigint")


def _with_name_facts(rows: DataFrame) -> DataFrame:
    """Block and what bounds the similarity of two names."""
    return rows.withColumns(
        {
            "block": sim.block_key(F.col("name")),
            "letters": _letter_mask(F.col("name")),
            "chars": F.length("name").cast("double"),
        }
    )


def match_cells(classes: DataFrame, cliques: bool) -> DataFrame:
    """One row per cell, named by its first visit, with what pairing needs."""
    cells = (
        _with_slot(classes, cliques)
        .groupBy(YEAR, "name", "sexe", "age", "day", "slot")
        .agg(F.min("no").alias("cell"), F.count(F.lit(1)).alias("size"), F.max("copies").alias("most"))
    )
    return _with_name_facts(cells)


def _tiled_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Inner join of ``l`` and ``r`` in which a crowded key is cut into tiles.

    Each side of a crowded key is cut into k parts by a hash and copied to the
    k parts of the other side, so every pair meets in exactly one tile and no
    task holds a whole key.
    """
    counts = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).count()
    crowded = counts.filter(F.col("count") > 2 * TILE_ROWS).select(
        *keys, F.ceil(F.col("count") / (2 * TILE_ROWS)).cast("int").alias("tiles")
    )
    few = few_rows_or_none(crowded)
    if few is None or few:
        own = F.pmod(F.xxhash64("cell"), F.coalesce("tiles", F.lit(1))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
        plain = left.columns, right.columns
        if few:
            crowded = F.broadcast(left.sparkSession.createDataFrame(few, crowded.schema))
            met = keys
        else:
            # Many crowded keys: the counts are copied to every salt, so that
            # the rows of a crowded key spread whatever the size of the sides.
            met = [*keys, "salt"]
            crowded = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salt = F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int")
            left, right = left.withColumn("salt", salt), right.withColumn("salt", salt)
        left = left.join(crowded, met, "left").select(*plain[0], own.alias("tile_l"), others.alias("tile_r"))
        right = right.join(crowded, met, "left").select(*plain[1], own.alias("tile_r"), others.alias("tile_l"))
        keys = [*keys, "tile_l", "tile_r"]
    equal = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    return left.alias("l").join(right.alias("r"), equal & condition)


def _may_reach() -> Column:
    """Upper bound of Jaro from word lengths and letters, against the step's need."""
    both = F.col("l.letters"), F.col("r.letters")
    matched = F.least(
        F.col("l.chars") - F.bit_count(both[0].bitwiseAND(F.bitwise_not(both[1]))),
        F.col("r.chars") - F.bit_count(both[1].bitwiseAND(F.bitwise_not(both[0]))),
    )
    bound = (matched / F.col("l.chars") + matched / F.col("r.chars") + 1) / 3
    return bound >= F.col("l.jaro") - F.lit(_SLACK)


def _exploded(cells: DataFrame, steps: list[Step]) -> DataFrame:
    options = F.array(
        *[
            F.struct(F.lit(s.ages).alias("ages"), F.lit(s.days).cast("bigint").alias("days"), F.lit(s.jaro).alias("jaro"))
            for s in steps
        ]
    )
    return cells.withColumn("step", F.explode(options)).select(*cells.columns, "step.*")


def _pair_columns(*more: Column) -> list[Column]:
    return [
        F.col(f"l.{YEAR}").alias(YEAR),
        F.col("l.cell").alias("a"),
        F.col("l.name").alias("name_a"),
        F.col("r.name").alias("name_b"),
        F.abs("l.ages").alias("ages"),
        *more,
    ]


def scored_cell_pairs(cells: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Cell pairs that can match, each once, with similarity and scores.

    ``score_near`` holds for a day distance of zero or a missing date and
    ``score_far`` for a distance of one; which applies depends on the moments
    and the order of the two visits. Pairs with ``score_near`` below the
    threshold are left out.
    """
    dated, undated = cells.filter("day is not null"), cells.filter("day is null")
    parts = []
    steps = allowed_steps(threshold)
    if steps:
        left = _exploded(dated, steps).withColumns(
            {"age": F.col("age") + F.col("ages"), "day": F.col("day") + F.col("days")}
        )
        once = (F.col("l.ages") > 0) | (F.col("l.days") > 0) | (F.col("l.cell") < F.col("r.cell"))
        joined = _tiled_join(left, dated, [YEAR, "block", "sexe", "age", "day"], once & _may_reach())
        parts.append(joined.select(*_pair_columns(F.col("r.cell").alias("b"), F.col("l.days").alias("days"))))
    steps = undated_steps(threshold)
    if steps:
        # Names are compared once per name, sex and age, then spread over days.
        people = cells.groupBy(YEAR, "block", "sexe", "age", "name", "letters", "chars").agg(
            F.min("cell").alias("cell")
        )
        left = _exploded(undated, steps).withColumn("age", F.col("age") + F.col("ages"))
        joined = _tiled_join(left, people, [YEAR, "block", "sexe", "age"], _may_reach())
        named = joined.select(
            *_pair_columns(F.col("r.sexe").alias("sexe_b"), F.col("r.age").alias("age_b"))
        ).withColumn("similarity", sim.jaro_winkler("name_a", "name_b"))
        near = sim.composite(F.col("similarity"), sim.age_score(F.col("ages")), F.lit(1.0))
        close = named.filter(near >= threshold).alias("p")
        others = cells.select(
            F.col(YEAR).alias("year_b"), F.col("name").alias("n"), F.col("sexe").alias("s"),
            F.col("age").alias("g"), F.col("cell").alias("b"), F.col("day").alias("day_b"),
        )
        same = (
            (F.col(YEAR) == F.col("year_b")) & (F.col("name_b") == F.col("n"))
            & (F.col("sexe_b") == F.col("s")) & (F.col("age_b") == F.col("g"))
        )
        # Two undated cells meet from both sides: keep one of the two.
        once = F.col("day_b").isNotNull() | (F.col("a") < F.col("b"))
        spread = close.join(others, same & once & (F.col("a") != F.col("b")))
        undated_pairs = spread.select(YEAR, "a", "b", "ages", F.lit(0).cast("bigint").alias("days"), "similarity")
    else:
        undated_pairs = None
    dated_pairs = None
    if parts:
        dated_pairs = (
            parts[0].withColumn("similarity", sim.jaro_winkler("name_a", "name_b"))
            .select(YEAR, "a", "b", "ages", "days", "similarity")
        )
    found = [p for p in (dated_pairs, undated_pairs) if p is not None]
    if not found:
        schema = f"{YEAR} int, a bigint, b bigint, similarity double, score_near double, score_far double"
        return cells.sparkSession.createDataFrame([], schema)
    age_part = sim.age_score(F.col("ages"))
    scored = reduce(DataFrame.unionByName, found).withColumns(
        {
            "score_near": sim.composite(F.col("similarity"), age_part, F.lit(1.0)),
            "score_far": sim.composite(F.col("similarity"), age_part, F.lit(0.0)),
        }
    )
    best = F.when(F.abs("days") <= 1, F.col("score_near")).otherwise(F.col("score_far"))
    return scored.filter(best >= threshold).select(YEAR, "a", "b", "similarity", "score_near", "score_far")


def _both_ways(steps: list[Step]) -> list[Step]:
    """Steps from either end of a pair."""
    turned = [Step(-s.ages, -s.days, s.needed) for s in steps if s.ages or s.days]
    return list(dict.fromkeys([*steps, *turned]))


def dropped_by_kept(rows: DataFrame, kept: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each class of ``rows`` that a kept class matches: ``annee``, ``no`` and ``by``, the first of these.

    All classes of ``kept`` come before those of ``rows`` in the order of their
    block. Kept classes hardly match each other, so few meet a row, however
    crowded its block is.
    """
    facts = [YEAR, "block", "sexe", "age", "name", "letters", "chars", "day", "at", "cell"]

    def prepared(classes: DataFrame) -> DataFrame:
        return _with_name_facts(_with_slot(classes, False)).withColumn("cell", F.col("no")).select(*facts)

    left, right = prepared(kept), prepared(rows)
    names = [
        F.col(f"l.{YEAR}").alias(YEAR), F.col("l.name").alias("name_a"), F.col("r.name").alias("name_b"),
        F.abs("l.ages").alias("ages"),
    ]
    age_part = sim.age_score(F.col("ages"))
    near, far = (sim.composite(F.col("similarity"), age_part, F.lit(x)) for x in (1.0, 0.0))
    found = []
    steps = _both_ways(allowed_steps(threshold))
    if steps:
        moved = _exploded(left.filter("day is not null"), steps).withColumns(
            {"age": F.col("age") + F.col("ages"), "day": F.col("day") + F.col("days")}
        )
        gap = sim.micros_gap(F.col("l.at"), F.col("r.at"))
        joined = _tiled_join(
            moved, right.filter("day is not null"), [YEAR, "block", "sexe", "age", "day"], (gap <= sim.DAY_TOLERANCE) & _may_reach()
        )
        met = joined.select(*names, F.col("l.cell").alias("by"), F.col("r.cell").alias("no"), gap.alias("gap"))
        score = F.when(F.col("gap") == 0, near).otherwise(far)
        scored = met.withColumn("similarity", sim.jaro_winkler("name_a", "name_b"))
        found.append(scored.filter(score >= threshold).select(YEAR, "no", "by"))
    steps = undated_steps(threshold)
    if steps:
        # A pair with an undated end: names are compared once per name, sex and age.
        who = [YEAR, "block", "sexe", "age", "name", "letters", "chars"]
        for a_end, b_end in (("day is null", "true"), ("day is not null", "day is null")):
            one, other = left.filter(a_end), right.filter(b_end)
            people = one.groupBy(*who).agg(F.min("cell").alias("cell"))
            moved = _exploded(people, steps).withColumn("age", F.col("age") + F.col("ages"))
            others = other.groupBy(*who).agg(F.min("cell").alias("cell"))
            joined = _tiled_join(moved, others, [YEAR, "block", "sexe", "age"], _may_reach())
            # The date counts for nothing here, so the first kept visit of a person is the first that matches.
            named = joined.select(
                *names, F.col("l.cell").alias("by"), F.col("r.sexe").alias("sexe"), F.col("r.age").alias("age")
            ).withColumn("similarity", sim.jaro_winkler("name_a", "name_b"))
            close = named.filter(near >= threshold).groupBy(YEAR, F.col("name_b").alias("name"), "sexe", "age").agg(F.min("by").alias("by"))
            found.append(other.join(close, [YEAR, "name", "sexe", "age"]).select(YEAR, F.col("cell").alias("no"), "by"))
    if not found:
        return rows.sparkSession.createDataFrame([], f"{YEAR} int, no bigint, by bigint")
    return reduce(DataFrame.unionByName, found).groupBy(YEAR, "no").agg(F.min("by").alias("by"))


def _neighbours(pairs: DataFrame, threshold: float) -> DataFrame:
    """Both directions of the cell pairs, with what decides a match."""
    flags = [(F.col("score_near") >= threshold).alias("near"), (F.col("score_far") >= threshold).alias("far")]
    forward = pairs.select(YEAR, F.col("a").alias("cell"), F.col("b").alias("other"), *flags)
    return forward.unionByName(pairs.select(YEAR, F.col("b").alias("cell"), F.col("a").alias("other"), *flags))


def _matches(earlier: Column, later: Column) -> Column:
    """Match of two visits of neighbouring cells, given the moment of each."""
    gap = sim.micros_gap(earlier, later)
    undated = earlier.isNull() | later.isNull()
    return F.when(undated | (gap == 0), F.col("near")).when(gap == 1, F.col("far")).otherwise(F.lit(False))


@dataclass
class KeepFirst:
    """Outcome of the order rule.

    ``members`` are the classes that have a copy or share a cell or a link with
    others, or that a kept visit of an earlier phase drops; ``kept`` are those
    of them that stay. All other classes stay. ``by`` is the visit that drops
    the member if any does, where no link is needed to tell. ``links`` are the
    matches of cells of one phase, each both ways and with itself.
    """

    kept: DataFrame
    members: DataFrame
    links: DataFrame
    rounds: int


def _busy_members(classes: DataFrame, cells: DataFrame, neighbours: DataFrame, cliques: bool) -> DataFrame:
    """Classes that can drop or be dropped, with cell and block; ``by`` is their cell if no other matches it."""
    contested = neighbours.select(YEAR, "cell").distinct().withColumn("contested", F.lit(True))
    busy = cells.join(contested, [YEAR, "cell"], "left").filter("contested or size > 1 or most > 1").alias("c")
    slotted = _with_slot(classes, cliques).alias("m")
    located = slotted.join(
        busy,
        (F.col(f"m.{YEAR}") == F.col(f"c.{YEAR}")) & (F.col("m.name") == F.col("c.name"))
        & (F.col("m.sexe") == F.col("c.sexe")) & (F.col("m.age") == F.col("c.age"))
        & F.col("m.slot").eqNullSafe(F.col("c.slot")),
    )
    return located.select(
        f"m.{YEAR}", "c.block", "c.cell", "m.no", "m.name", "m.sexe", "m.age", "m.at", "m.copies",
        F.when(F.col("c.contested").isNull(), F.col("c.cell")).alias("by"),
    )


def _bucketed(open_cells: DataFrame, by_days: bool) -> DataFrame:
    """Adds a bucket to open cells, so that most matching cells meet in one.

    A bucket holds whole blocks of one sex where they are small. A larger block
    is cut by days, or in every second round by name, so that a chain of
    lookalikes over either is followed to its end. Cells of one name are one
    per age and day, so a bucket has a bound that does not grow with visits.
    """
    group = [YEAR, "block", "sexe"]
    sizes = open_cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    parts = F.ceil(F.col("_size") / F.lit(float(BUCKET_CELLS)))
    small = F.col("_parts") == 1
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("_size") <= BUCKET_CELLS, F.col("_size"))), F.lit(0))).first()[0]
    shared = F.xxhash64(F.lit("small"), F.pmod(F.xxhash64(*group), F.lit(total // BUCKET_CELLS + 1)))
    sized = sizes.withColumn("_parts", parts)
    placed = open_cells.join(sized, group)
    part = F.pmod(F.xxhash64("name"), F.col("_parts"))
    if by_days:
        days = open_cells.groupBy(*group, "day").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.withColumn("_window", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(float(BUCKET_CELLS))))
        equal = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"d.{k}") for k in group])
        placed = placed.alias("p").join(days.alias("d"), equal & F.col("p.day").eqNullSafe(F.col("d.day")))
        placed = placed.select("p.*", "d._window")
        part = F.when(F.col("day").isNull(), -1 - part).otherwise(F.col("_window"))
    bucket = F.when(small, shared).otherwise(F.xxhash64(*group, F.lit(by_days), part))
    return placed.select(YEAR, "cell", "first", bucket.alias("bucket"))


def _decided(open_rows: DataFrame, places: DataFrame, neighbours: DataFrame, cliques: bool, by_days: bool) -> DataFrame:
    """What the sweeps of all buckets decide: ``annee``, ``cell``, ``no``, ``kept``."""
    first = open_rows.groupBy(YEAR, "cell").agg(F.min("no").alias("first"))
    placed = staged(_bucketed(first.join(places, [YEAR, "cell"]), by_days), "buckets")
    there = placed.select(YEAR, F.col("cell").alias("other"), F.col("first").alias("other_first"), F.col("bucket").alias("other_bucket"))
    links = staged(
        neighbours.join(placed.drop("first"), [YEAR, "cell"]).join(there, [YEAR, "other"]), "open-links"
    )
    outside = links.filter("bucket != other_bucket").groupBy(YEAR, "cell").agg(F.min("other_first").alias("outside"))
    by_order = F.row_number().over(Window.partitionBy(YEAR, "cell").orderBy("no"))
    # Only the first few open visits of a cell are sent; later ones wait.
    sent = open_rows.withColumn("_r", by_order).filter(F.col("_r") <= SENT + 1)
    rest = sent.filter(F.col("_r") > SENT).select(YEAR, "cell", F.col("no").alias("rest"))
    last = F.lit(sweeping.LAST)
    visits = (
        sent.filter(F.col("_r") <= SENT).join(placed.drop("first"), [YEAR, "cell"])
        .join(outside, [YEAR, "cell"], "left").join(rest, [YEAR, "cell"], "left")
        .select(
            F.col(YEAR).cast("int").alias("year"), "cell", "no", F.coalesce("at", F.lit(0)).alias("at"),
            F.col("at").isNotNull().alias("dated"), F.coalesce("outside", last).alias("outside"),
            F.coalesce("rest", last).alias("rest"), "bucket",
        )
    )
    inner = links.filter("bucket = other_bucket").select(F.col(YEAR).cast("int").alias("year"), "cell", "other", "near", "far", "bucket")

    def solve(key, own, around):
        return sweeping.sweep(own, around, cliques)

    solved = visits.groupBy("bucket").cogroup(inner.groupBy("bucket")).applyInPandas(
        solve, "year int, cell bigint, no bigint, kept boolean"
    )
    return solved.select(F.col("year").alias(YEAR), "cell", "no", "kept")


def _in_phases(classes: DataFrame) -> tuple[DataFrame, int]:
    """``classes`` with the number of their ``phase``, and the number of phases.

    A phase holds a run of the order of one year, block and sex. Only crowded
    ones have more than one, and only their borders are looked for.
    """
    group = [YEAR, "block", "sexe"]
    blocked = classes.withColumn("block", sim.block_key(F.col("name")))
    crowded = blocked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PHASE_CLASSES)
    most = crowded.agg(F.max("_n")).first()[0]
    if most is None:
        return classes.withColumn("phase", F.lit(0)), 1
    shares = []
    while most > PHASE_CLASSES:
        most /= PHASE_GROWTH
        shares.append(1 / PHASE_GROWTH ** (len(shares) + 1))
    inside = blocked.join(small_side(crowded.select(*group)), group, "left_semi")
    # Borders need not be exact: any cut of the order gives the same result.
    borders = inside.groupBy(*group).agg(F.percentile_approx("no", F.array(*map(F.lit, shares)), 1000).alias("_borders"))
    placed = blocked.join(small_side(borders), group, "left")
    passed = F.size(F.filter("_borders", lambda b: F.col("no") > b))
    phase = F.when(F.col("_borders").isNotNull() & F.col("no").isNotNull(), passed).otherwise(0)
    return placed.withColumn("phase", phase.cast("int")).select(*classes.columns, "phase"), len(shares) + 1


def keep_first(classes: DataFrame, threshold: float = THRESHOLD) -> KeepFirst:
    """Solve the order rule over classes, phase by phase.

    What a kept class of an earlier phase matches is dropped; the others of a
    phase are solved among themselves. No class of a later phase comes before
    them, so this is what the scan in order decides.
    """
    classes, phases = _in_phases(staged(classes, "classes"))
    if phases == 1:
        return _solved(classes.drop("phase"), threshold)
    classes = staged(classes, "phases")
    parts, stays = [], None
    rounds = 0
    for phase in range(phases):
        rest = classes.filter(F.col("phase") == phase).drop("phase")
        if stays is not None:
            by = staged(dropped_by_kept(rest, stays, threshold), "dropped-by-kept")
            lost = rest.join(by, [YEAR, "no"]).select(
                YEAR, sim.block_key(F.col("name")).alias("block"), F.col("no").alias("cell"), "no", "name", "sexe", "age", "at", "copies", "by"
            )
            rest = staged(rest.join(by, [YEAR, "no"], "left_anti"), "rest")
        solved = _solved(rest, threshold)
        rounds += solved.rounds
        gone = solved.members.join(solved.kept.select(YEAR, "no"), [YEAR, "no"], "left_anti").select(YEAR, "no")
        won = rest.join(gone, [YEAR, "no"], "left_anti")
        if stays is not None:
            solved.members = solved.members.unionByName(lost)
            won = stays.unionByName(won)
        parts.append(solved)
        if phase + 1 < phases:
            stays = staged(won, "stays")
    union = {name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts]) for name in ("kept", "members", "links")}
    return KeepFirst(staged(union["kept"], "kept"), staged(union["members"], "members"), union["links"], rounds)


def _solved(classes: DataFrame, threshold: float) -> KeepFirst:
    """Solve the order rule over written classes with all their pairs.

    Only classes that may drop another or be dropped are carried. In a round,
    cells stand in buckets; each bucket goes through its visits in order and
    decides all that do not hang on an open visit of another bucket. Then kept
    visits drop their matches in other buckets. The first open visit of a block
    is always decided, so rounds end; buckets that hold whole blocks need one.
    Every round writes its outcome, which keeps plans short.
    """
    cliques = cells_are_cliques(threshold)
    cells = staged(match_cells(classes, cliques), "cells")
    neighbours = staged(_neighbours(scored_cell_pairs(cells, threshold), threshold), "neighbours")
    members = staged(_busy_members(classes, cells, neighbours, cliques), "members")
    own = F.lit(True).alias("near"), F.lit(cliques).alias("far")
    selves = members.filter("by is null").select(YEAR, "cell").distinct().select(YEAR, "cell", F.col("cell").alias("other"), *own)
    links = neighbours.unionByName(selves)
    # An uncontested cell keeps its first visit: all of them match each other.
    kept = [members.filter("by = no").select(YEAR, "cell", "no", "at")]
    open_rows = members.filter("by is null").select(YEAR, "cell", "no", "at")
    places = cells.select(YEAR, "cell", "block", "sexe", "name", "day")
    rounds = 0
    while not open_rows.isEmpty():
        decided = staged(_decided(open_rows, places, neighbours, cliques, rounds % 2 == 0), "decided")
        won = open_rows.join(decided.filter("kept").select(YEAR, "no"), [YEAR, "no"], "left_semi")
        won = staged(won.select(YEAR, "cell", "no", "at"), "won")
        kept.append(won)
        rounds += 1
        left = open_rows.join(decided.select(YEAR, "no"), [YEAR, "no"], "left_anti")
        if left.isEmpty():
            break
        hits = won.select(YEAR, "cell", F.col("no").alias("k_no"), F.col("at").alias("k_at")).join(links, [YEAR, "cell"])
        hits = hits.select(YEAR, F.col("other").alias("cell"), "k_no", "k_at", "near", "far")
        lost = (
            (F.col(f"o.{YEAR}") == F.col(f"h.{YEAR}")) & (F.col("o.cell") == F.col("h.cell"))
            & (F.col("h.k_no") < F.col("o.no")) & _matches(F.col("h.k_at"), F.col("o.at"))
        )
        open_rows = staged(left.alias("o").join(hits.alias("h"), lost, "left_anti").select(YEAR, "cell", "no", "at"), "round")
    return KeepFirst(staged(reduce(DataFrame.unionByName, kept), "kept"), members, links, rounds)


def dropped_visits(df: DataFrame, outcome: KeepFirst) -> DataFrame:
    """Year, block and number of every dropped visit: dropped classes, and copies of any class."""
    dropped = outcome.members.join(outcome.kept.select(YEAR, "no"), [YEAR, "no"], "left_anti").select(YEAR, "block", F.col("no").alias(ORDER))
    copied = outcome.members.filter("copies > 1").select(YEAR, "block", "name", "sexe", "age", "at", "no").alias("c")
    visits = _compared(df).alias("v")
    same = reduce(lambda a, b: a & b, [F.col(f"v.{k}") == F.col(f"c.{k}") for k in (YEAR, "name", "sexe", "age")])
    copies = visits.join(copied, same & F.col("v.at").eqNullSafe(F.col("c.at")) & (F.col("v.no") > F.col("c.no")))
    return dropped.unionByName(copies.select(f"v.{YEAR}", "c.block", F.col("v.no").alias(ORDER)))


def without_dropped(df: DataFrame, outcome: KeepFirst | None, dropped: DataFrame | None = None) -> DataFrame:
    """``df`` without its dropped visits; only their keys are carried."""
    if outcome is None:
        return df
    gone = dropped_visits(df, outcome) if dropped is None else dropped
    return df.join(gone.select(YEAR, ORDER), [YEAR, ORDER], "left_anti")


def _first_matches(outcome: KeepFirst) -> DataFrame:
    """For dropped visits: the kept visit that removed them, and how many it removed."""
    dropped = outcome.members.join(outcome.kept.select(YEAR, "no"), [YEAR, "no"], "left_anti")
    kept = outcome.kept.select(YEAR, F.col("cell").alias("other"), F.col("no").alias("k_no"), F.col("at").alias("k_at"))
    known = dropped.filter("by is not null").select(YEAR, "block", "no", "copies", F.col("by").alias("k_no"))
    reached = dropped.filter("by is null").join(outcome.links, [YEAR, "cell"]).join(kept, [YEAR, "other"])
    found = (
        reached.filter((F.col("k_no") < F.col("no")) & _matches(F.col("k_at"), F.col("at")))
        .groupBy(YEAR, "block", "no", "copies").agg(F.min("k_no").alias("k_no"))
    )
    removed = found.unionByName(known).select(YEAR, "block", "k_no", F.col("copies").alias("n"))
    copies = outcome.members.filter("copies > 1").join(outcome.kept.select(YEAR, "no"), [YEAR, "no"], "left_semi")
    own = copies.select(YEAR, "block", F.col("no").alias("k_no"), (F.col("copies") - 1).alias("n"))
    return removed.unionByName(own).groupBy(YEAR, "block", "k_no").agg(F.sum("n").alias("n"))


def _ranks(rows: DataFrame) -> DataFrame:
    """Rank by ``no`` inside each block, in two levels so a large block is spread.

    The buckets are cut at quantiles of the numbers that occur, so a few far
    numbers don't push all others into one bucket.
    """
    at = [i / _RANK_BUCKETS for i in range(1, _RANK_BUCKETS)]
    borders = rows.select(F.percentile_approx("no", F.array(*map(F.lit, at)), 20 * _RANK_BUCKETS).alias("b")).first()["b"]
    # Rounding to doubles keeps the order, so equal buckets still hold neighbours only.
    splits = [float("-inf"), *sorted({float(b) for b in borders or []}), float("inf")]
    cut = Bucketizer(splits=[*splits[:-1], 0.0, splits[-1]] if len(splits) == 2 else splits, inputCol="_no", outputCol="_bucket")
    placed = cut.transform(rows.withColumn("_no", F.col("no").cast("double"))).drop("_no")
    sizes = placed.groupBy(YEAR, "block", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(YEAR, "block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(YEAR, "block", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(YEAR, "block", "_bucket").orderBy("no")
    return placed.join(offsets, [YEAR, "block", "_bucket"]).select(
        YEAR, "block", "no", (F.row_number().over(inside) + F.col("_offset")).alias("rank")
    )


def pairs_evaluated(rows: DataFrame, outcome: KeepFirst | None, dropped: DataFrame | None) -> DataFrame:
    """Per year, the pairs an ordered scan of each block would have looked at.

    ``rows`` holds year, block and number of all visits (a null block has no
    pairs), ``dropped`` those of the dropped ones. A kept visit is met by every
    earlier kept visit of its block; a dropped one by the kept visits up to the
    one that dropped it. Counting needs ranks only, no pairs.
    """
    blocks = rows.filter("block is not null").groupBy(YEAR, "block").agg(F.count(F.lit(1)).alias("k"))
    if outcome is not None:
        gone = dropped.groupBy(YEAR, "block").agg(F.count(F.lit(1)).alias("gone"))
        blocks = blocks.join(gone, [YEAR, "block"], "left").withColumn("k", F.col("k") - F.coalesce("gone", F.lit(0)))
    size = F.col("k").cast("decimal(38,0)")
    pairs = blocks.groupBy(YEAR).agg(F.sum((size * (size - 1) / 2).cast("decimal(38,0)")).alias("pairs"))
    if outcome is not None:
        removed = staged(_first_matches(outcome), "removers")
        crowded = removed.select(YEAR, "block").distinct()
        gone = dropped.select(YEAR, F.col(ORDER).alias("no"))
        left = rows.join(crowded, [YEAR, "block"], "left_semi").join(gone, [YEAR, "no"], "left_anti")
        ranked = _ranks(staged(left.select(YEAR, "block", "no"), "block-rows"))
        met = removed.join(ranked, (removed[YEAR] == ranked[YEAR]) & (removed["k_no"] == ranked["no"])).groupBy(
            removed[YEAR]
        ).agg(F.sum((F.col("n") * F.col("rank")).cast("decimal(38,0)")).alias("pairs"))
        pairs = pairs.unionByName(met)
    return pairs.groupBy(YEAR).agg(F.sum("pairs").cast("bigint").alias("n_paires_evaluees"))


def dedup_report(df: DataFrame, outcome: KeepFirst | None, dropped: DataFrame | None = None) -> DataFrame:
    """Rows before and after, duplicates and their rate, pairs; one row a year.

    The visits are read once, for year, block and number; ``dropped`` holds the
    keys of the dropped visits where they are known.
    """
    block = F.when(F.col(NAME) != "", sim.block_key(F.col(NAME))).alias("block")
    rows = staged(df.select(YEAR, block, F.col(ORDER).alias("no")), "visit-blocks")
    result = rows.groupBy(YEAR).agg(F.count(F.lit(1)).alias("n_avant"))
    removed = F.lit(0).cast("bigint")
    if outcome is not None:
        dropped = dropped_visits(df, outcome) if dropped is None else dropped
        result = result.join(dropped.groupBy(YEAR).agg(F.count(F.lit(1)).alias("gone")), YEAR, "left")
        removed = F.coalesce("gone", F.lit(0)).cast("bigint")
    return result.join(pairs_evaluated(rows, outcome, dropped), YEAR, "left").select(
        YEAR,
        "n_avant",
        (F.col("n_avant") - removed).alias("n_apres"),
        removed.alias("n_doublons_supprimes"),
        round_half_even(100 * removed / F.col("n_avant"), 2).alias("taux_doublons_pct"),
        F.coalesce("n_paires_evaluees", F.lit(0)).cast("bigint").alias("n_paires_evaluees"),
    )


def deduplicate(df: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(clean visits, report per year); ``visit_no`` has to be unique in a year."""
    outcome = dropped = None
    # A threshold above the score of equal visits drops nothing.
    if sim.composite_value(1.0, 1.0, 1.0) >= threshold:
        outcome = keep_first(match_classes(df), threshold)
        dropped = staged(dropped_visits(df, outcome), "dropped")
    return without_dropped(df, outcome, dropped), dedup_report(df, outcome, dropped)
