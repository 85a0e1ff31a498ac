"""Near-duplicate texts: Jaccard join of word shingles by parity sketches.

Every shingle is XOR-hashed twice: into one bit of a bit sketch, so that the
Hamming distance of two sketches is at most the size of the symmetric
difference, and into one 64-bit word of a row of parts. A link at 0.8 leaves
few shingles unshared for its size, so most parts of two linked texts are
untouched and equal: parts are joined on equality, per band of sizes.

* A size band holds sizes that differ by a factor of 1.25, so linked texts lie
  in one band or in neighbours; each text stands in the scheme of its own band
  and in that of the band below.
* Schemes up to 48 shingles have one part per shingle: every link shares one.
  Larger schemes have 0.4 parts per shingle, 48 at least, of which 48 are
  joined. A linked pair at the threshold leaves a part untouched with
  probability 0.458 or more, so it has no equal part among 44 filled ones with
  probability 2e-12 at most (parts are chosen by hash, not by place in the text).
* A linked pair has many equal parts, so a text that shares fewer than 5 part
  values with any other text has no link (1e-7 for a pair at the threshold);
  with one part per shingle it has to share four fifths, which is exact.
* Equal sets are one class before the join. Within the texts of one part value
  only a star of links to the smallest text is tried first. Texts that are in
  one component already need no more; other texts of a group of up to 64 are
  compared by their sketches, as matrices, so that only possible pairs get rows. The
  equal parts of a linked pair may all lie in larger groups, and cold parts say
  nothing about that: in a family of one template they are just those that the
  edits touched. So only a text with fewer than 5 part values in larger groups
  needs none of them (with one part per shingle, fewer than four fifths): one of
  its equal parts is in a small group. For the others, stars with other centres
  follow, and what still stands apart is compared in tiles of 1024.
* Candidates pass the sketch bound, then are verified on the shingle hashes.

Nothing is capped: a pair is skipped only if it is linked through others or
proven to be below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.components import components
from recordloom.llm.shared import staged
from recordloom.llm.shingles import mix, shingle_set, word_hashes

RATIO = 1.25
WHOLE = 48
PARTS = 48
SHARED = 5
SMALL_GROUP = 64
TILE = 1024
STARS = 2
FEATURES = "doc_id long, n_shingles long, key1 long, key2 long, parts array<long>, bits binary"


def scheme(n: int) -> int:
    return int(math.floor(math.log(n) / math.log(RATIO) + 1e-9))


def part_values(shingles: np.ndarray, number: int) -> np.ndarray:
    """Part values of a set under a scheme; the lowest byte names the scheme."""
    low = RATIO**number
    tag = np.uint64(number & 0xFF)
    if low <= WHOLE:
        words = shingles
    else:
        count = np.uint64(max(PARTS, math.ceil(0.4 * low)))
        place = (shingles >> np.uint64(20)) % count
        chosen = place < PARTS
        place, inside = place[chosen].astype(np.int64), shingles[chosen]
        parity = np.zeros(PARTS, np.uint64)
        np.bitwise_xor.at(parity, place, mix(inside))
        filled = np.bincount(place, minlength=PARTS) > 0
        words = (parity + np.arange(PARTS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[filled]
    return (mix(words ^ mix(np.array([number + 77], np.uint64))) & ~np.uint64(0xFF)) | tag


def number_of(part: Column) -> Column:
    """Scheme of a part value."""
    return F.col(part).bitwiseAND(F.lit(0xFF))


def by_shingle(number: Column) -> Column:
    """Whether a scheme has one part per shingle (the byte of scheme -1 is 255)."""
    last = max(n for n in range(200) if RATIO**n <= WHOLE)
    return (number <= last) | (number == 255)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """One parity bit per shingle; the width is a power of two near twice the set's size."""
    width = 64
    while width < 2 * len(shingles):
        width *= 2
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (width - 1), minlength=width)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the wider one is folded, which keeps the bound."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def features(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, words in zip(batch["doc_id"], word_hashes([(t or "").encode() for t in batch["text"]])):
                s = shingle_set(words, width)
                if not len(s):
                    out.append((key, 0, 0, 0, [], b""))
                    continue
                own = scheme(len(s))
                parts = np.concatenate([part_values(s, own), part_values(s, own - 1)])
                out.append(
                    (key, len(s), int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)),
                     parts.view(np.int64), bit_sketch(s))
                )
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "key1", "key2", "parts", "bits"])

    return rows.mapInPandas(run, FEATURES)


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """Upper halves of the shingle hashes of each text, sorted, 4 bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = word_hashes([(t or "").encode() for t in batch["text"]])
            sets = [(shingle_set(w, width) >> np.uint64(32)).astype("<u4").tobytes() for w in words]
            yield pd.DataFrame({"id": batch["id"], "set": sets})

    return rows.mapInPandas(run, "id long, set binary")


def overlap(a: bytes, b: bytes) -> int:
    """Common members of two sorted lists, equal members counted as often as both hold them."""
    both = np.concatenate([np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")])
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if len(x) == len(np.unique(x)) and len(y) == len(np.unique(y)):
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())
    u, cu = np.unique(x, return_counts=True)
    v, cv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, return_indices=True)
    return int(np.minimum(cu[i], cv[j]).sum())


def possible_in_group(members: list, percent: int) -> list[tuple[int, int]]:
    """Pairs of a group that size and sketch allow and that stand in different components."""
    by_width: dict[int, list] = {}
    for m in members:
        by_width.setdefault(len(m["bits"]), []).append(m)
    found = set()
    widths = sorted(by_width)
    for i, w in enumerate(widths):
        for v in widths[i:]:
            small, large = by_width[w], by_width[v]
            x = np.frombuffer(b"".join(m["bits"] for m in small), "<u8").reshape(len(small), -1)
            y = np.frombuffer(b"".join(m["bits"] for m in large), "<u8").reshape(len(large), -1)
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            n, k = np.array([m["n"] for m in small]), np.array([m["n"] for m in large])
            r, q = np.array([m["root"] for m in small]), np.array([m["root"] for m in large])
            step = max(1, (1 << 21) // y.size)
            for at in range(0, len(small), step):
                some = slice(at, at + step)
                apart = np.bitwise_count(x[some, None, :] ^ y[None, :, :]).sum(-1, dtype=np.int64)
                total = n[some, None] + k[None, :]
                fits = (apart <= total * (100 - percent) // (100 + percent)) & (r[some, None] != q[None, :])
                fits &= 100 * np.minimum(n[some, None], k[None, :]) >= percent * np.maximum(n[some, None], k[None, :])
                for a, b in zip(*np.nonzero(fits)):
                    one, two = small[at + a]["id"], large[b]["id"]
                    found.add((min(one, two), max(one, two)))
    return sorted(found)


class Verifier:
    """Links among candidate pairs, decided on exact sets."""

    def __init__(self, rows: DataFrame, reps: DataFrame, width: int, percent: int):
        self.rows, self.reps, self.width, self.percent = rows, reps, width, percent

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that size and sketch allow; ``a`` is the text with more partners."""
        percent = self.percent
        side = self.reps.select("id", "n", "bits")
        left = side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        right = side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))

        @F.pandas_udf("boolean")
        def near(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(
                [hamming(p, q) <= most_apart(m, n, percent) for m, n, p, q in zip(na.tolist(), nb.tolist(), x, y)], dtype=bool
            )

        sized = pairs.join(right, "b").join(left, "a").where("100 * least(na, nb) >= 80 * greatest(na, nb)".replace("80", str(percent)))
        return sized.where(near("na", "nb", "bits_a", "bits_b")).select("a", "b", "na", "nb")

    def possible_in_groups(self, named: DataFrame, large: bool = False) -> DataFrame:
        """Possible pairs among the texts of each part value, from rows of ``part``, ``id`` and ``root``.

        A group is cut into tiles; every two tiles meet in one row of at most
        about twice the tile size, so no group stands in one task. ``large``
        groups are handed over one by one, small ones in batches.
        """
        percent = self.percent
        tiles = named.groupBy("part").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        member = F.struct("id", "root", "n", "bits")
        dealt = (
            named.join(tiles, "part").join(self.reps.select("id", "n", "bits"), "id")
            .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
            .select("part", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), member.alias("member"))
        )
        met = dealt.select("part", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "member")

        def batches_of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pairs = [p for members in batch["members"] for p in possible_in_group(list(members), percent)]
                yield pd.DataFrame(pairs, columns=["a", "b"])

        def one_group(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(possible_in_group(group.to_dict("records"), percent), columns=["a", "b"], dtype="int64")

        if large:
            flat = met.select("part", "lo", "hi", "member.*")
            return flat.groupBy("part", "lo", "hi").applyInPandas(one_group, "a long, b long").distinct()
        met = met.groupBy("part", "lo", "hi").agg(F.collect_list("member").alias("members"))
        return met.select("members").mapInPandas(batches_of_groups, "a long, b long").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        pairs = staged(self.possible(pairs), "possible-pairs")
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = staged(shingle_sets(self.rows.join(wanted, "id"), self.width), "shingle-sets")

        @F.pandas_udf("boolean")
        def linked(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
            common = [overlap(p, q) for p, q in zip(x, y)]
            return pd.Series(
                [100 * c >= percent * (m + n - c) for c, m, n in zip(common, na.tolist(), nb.tolist())], dtype=bool
            )

        a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        # more texts share a centre ``a`` than a ``b``: sets travel with ``b`` once, then meet their centre
        return staged(pairs.join(b, "b").join(a, "a").where(linked("na", "nb", "set_a", "set_b")).select("a", "b"), "links-found")


def near_duplicates(docs: DataFrame, key: Column, text: Column, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets
    of ``width``-word shingles. A text with fewer words is one shingle; null,
    empty and blank texts have none, link with nothing and are components of
    their own. Keys shall be distinct; rows of equal key are taken together.
    Null keys keep their row, with a null component, and link with nothing.
    """
    base = docs.select(key.cast("long").alias("doc_id"), text.alias("text"))
    known = staged(features(base, width), "features")
    classes = known.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "key1", "key2").agg(
        F.min("doc_id").alias("id")
    )
    classes = staged(classes, "classes")
    at = [F.col("k.n_shingles") == F.col("c.n_shingles"), F.col("k.key1") == F.col("c.key1"), F.col("k.key2") == F.col("c.key2")]
    member = [*at, F.col("k.doc_id") == F.col("c.id")]
    reps = known.alias("k").join(classes.alias("c"), member, "left_semi").dropDuplicates(["doc_id"]).select(
        F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "parts", "bits"
    )
    reps = staged(reps, "class-representatives")
    values = reps.select("id", F.explode("parts").alias("part"))
    groups = values.groupBy("part").agg(F.count("*").alias("g"), F.min("id").alias("centre")).where("g > 1")
    shared = staged(values.join(groups, "part").withColumn("scheme", number_of("part")), "shared-parts")
    total = reps.select("id", F.explode(F.transform("parts", lambda x: x.bitwiseAND(F.lit(0xFF)))).alias("scheme"))
    total = total.groupBy("id", "scheme").agg(F.count("*").alias("all"))
    big = F.sum(F.when(F.col("g") > SMALL_GROUP, 1).otherwise(0))
    known_parts = shared.groupBy("id", "scheme").agg(F.count("*").alias("some"), big.alias("hot")).join(total, ["id", "scheme"])
    exact = by_shingle(F.col("scheme"))
    known_parts = known_parts.where(F.when(exact, 100 * F.col("some") >= percent * F.col("all")).otherwise(F.col("some") >= SHARED))
    needy = F.when(exact, 100 * F.col("hot") >= percent * F.col("all")).otherwise(F.col("hot") >= SHARED)
    known_parts = known_parts.select("id", "scheme", needy.alias("needy"))
    shared = shared.drop("g", "centre").join(known_parts, ["id", "scheme"])
    groups = shared.groupBy("part").agg(F.count("*").alias("g"), F.min("id").alias("centre")).where("g > 1")
    shared = staged(shared.join(groups, "part"), "promising-parts")

    rows = base.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text")
    rows = rows.join(reps.select("id"), "id", "left_semi")
    verify = Verifier(rows, reps, width, percent)
    star = lambda t: t.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = verify.links(star(shared))
    roots = components(links)
    tried = star(shared)

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of those part values whose texts stand in several components, with the component."""
        named = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = named.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
        return named.join(open_.select("part"), "part", "left_semi").select("part", "id", "root")

    pairs = verify.possible_in_groups(apart(shared.where(F.col("g") <= SMALL_GROUP)))
    links = links.unionByName(verify.links(pairs.join(tried, ["a", "b"], "left_anti")))

    crowded = shared.where((F.col("g") > SMALL_GROUP) & F.col("needy")).select("id", "part")
    crowded = staged(crowded, "crowded-parts")
    for turn in range(STARS):
        if crowded.isEmpty():
            break
        roots = components(links)
        left = staged(apart(crowded), "open-parts")
        if left.isEmpty():
            break
        if turn < STARS - 1:
            centre = F.min_by(F.struct(F.col("id").alias("centre"), F.col("root").alias("centre_root")), F.xxhash64("id", "part", F.lit(turn)))
            centres = left.groupBy("part").agg(centre.alias("c")).select("part", "c.*")
            named = left.join(centres, "part").where("root != centre_root")
            links = links.unionByName(verify.links(star(named)))
        else:
            links = links.unionByName(verify.links(verify.possible_in_groups(left, large=True)))
    roots = components(links).withColumnRenamed("node", "id")
    of_class = classes.join(roots, "id", "left").select("n_shingles", "key1", "key2", F.coalesce("root", "id").alias("component"))
    return known.alias("k").join(of_class.alias("c"), at, "left").select(
        "k.doc_id", "k.n_shingles",
        F.when(F.col("k.doc_id").isNotNull(), F.coalesce("c.component", "k.doc_id")).alias("component_id"),
    )


def query(docs: DataFrame) -> DataFrame:
    """Class of every document."""
    return near_duplicates(docs, F.col("doc_id"), F.col("text"))
