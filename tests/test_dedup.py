import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity as sim
from recordloom.operators import dedup

SCHEMA = "annee int, visit_no bigint, nom_complet_norm string, sexe string, age int, date_entree timestamp_ntz"


def soundex(word):
    codes = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
    out, last = word[0].upper(), codes.get(word[0])
    for c in word[1:]:
        if c in codes:
            if codes[c] != last:
                out += codes[c]
            last = codes[c]
        elif c not in "hw":
            last = None
    return (out + "000")[:4]


def scan(rows, threshold):
    """The ordered scan, one pair after another."""
    dropped, pairs = set(), {}
    blocks = {}
    for r in sorted(rows, key=lambda r: r[1]):
        if r[2]:
            blocks.setdefault((r[0], soundex(r[2].split(" ")[0])), []).append(r)
    for (year, _), block in blocks.items():
        for i, a in enumerate(block):
            for b in block[i + 1:]:
                if (year, a[1]) in dropped or (year, b[1]) in dropped:
                    continue
                pairs[year] = pairs.get(year, 0) + 1
                if a[3] is None or a[3] != b[3] or a[4] is None or b[4] is None or abs(a[4] - b[4]) > 2:
                    continue
                gap = 0
                if a[5] and b[5]:
                    gap = abs((a[5] - b[5]).days)
                    if gap > 1:
                        continue
                s = sim.jaro_winkler_values([a[2]], [b[2]])[0]
                score = 0.7 * s + 0.2 * (1 - min(abs(a[4] - b[4]) / 2, 1)) + 0.1 * (1 - min(gap, 1))
                if score >= threshold:
                    dropped.add((year, b[1]))
    return {(r[0], r[1]) for r in rows} - dropped, pairs


def check(spark, rows, threshold=0.85):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    clean, report = dedup.deduplicate(df, threshold)
    want, pairs = scan(rows, threshold)
    assert {(r.annee, r.visit_no) for r in clean.collect()} == want
    out = {r.annee: r for r in report.collect()}
    for year in {r[0] for r in rows}:
        n = sum(r[0] == year for r in rows)
        kept = sum(y == year for y, _ in want)
        assert (out[year].n_avant, out[year].n_apres, out[year].n_doublons_supprimes) == (n, kept, n - kept)
        assert out[year].n_paires_evaluees == pairs.get(year, 0)
    return clean, out


def fixture_rows():
    d = dt.datetime
    ten = d(2023, 9, 1, 10)
    return [
        (2023, 1, "awa diop", "Femme", 30, ten),
        (2023, 2, "awa diopp", "Femme", 30, d(2023, 9, 1, 11)),
        (2023, 3, "awa diop", "Femme", 31, ten),
        (2023, 4, "awa diop", None, 30, ten),
        (2023, 5, "awa diop", "Femme", 32, ten),
        (2023, 6, "", "Femme", 30, None),
        (2023, 7, "awa sarr", "Femme", 30, d(2023, 9, 1, 9)),
        (2023, 8, "awa diop", "Femme", 30, None),
        (2023, 9, "awa diop", "Homme", 30, ten),
    ]


def test_fixture(spark):
    clean, report = check(spark, fixture_rows())
    assert {r.visit_no for r in clean.collect()} == {1, 4, 5, 6, 7, 9}
    assert report[2023].n_paires_evaluees == 13
    assert report[2023].taux_doublons_pct == pytest.approx(33.33)


def test_fixture_scores(spark):
    df = spark.createDataFrame(fixture_rows(), SCHEMA)
    cells = dedup.match_cells(dedup.match_classes(df), cliques=False)
    pairs = dedup.scored_cell_pairs(cells, threshold=0.75).collect()
    got = {tuple(sorted((r.a, r.b))): r for r in pairs}
    near = {(1, 3): 0.9, (1, 5): 0.8, (1, 8): 1.0, (2, 8): 0.984444, (3, 5): 0.9, (3, 8): 0.9, (5, 8): 0.8, (7, 8): 0.766667}
    far = {(1, 2): 0.884444}
    for pair, score in near.items():
        assert got[pair].score_near == pytest.approx(score, abs=1e-6)
    for pair, score in far.items():
        assert got[pair].score_far == pytest.approx(score, abs=1e-6)
    assert len(got) == len(pairs)


def random_rows(n, seed, hot=False):
    rng = random.Random(seed)
    first = ["awa", "aawa", "mamadou", "mamadu", "fatou"]
    last = ["diop", "diopp", "diob", "sarr", "fall", "falle", "ndiaye"]
    rows = []
    for i in range(n):
        name = rng.choice(["", f"{rng.choice(first)} {rng.choice(last)}", rng.choice(first)])
        if hot and rng.random() < 0.5:
            name = "awa diop"
        age = rng.choice([None, 30, 30, 31, 32, 33])
        if hot and rng.random() < 0.5:
            age = 30
        at = dt.datetime(2023, 9, 1) + dt.timedelta(hours=rng.randint(0, 110), minutes=rng.choice([0, 30]))
        rows.append((2023 + (rng.random() < 0.3), i, name, rng.choice(["Femme", "Femme", "Homme", None]), age,
                     None if rng.random() < 0.15 else at))
    return rows


@pytest.mark.parametrize("threshold", [0.85, 0.78, 0.93, 1.2])
def test_against_ordered_scan(spark, threshold):
    check(spark, random_rows(260, 11), threshold)


def test_hot_name_against_ordered_scan(spark):
    check(spark, random_rows(300, 12, hot=True))


def test_tiles_give_the_same_pairs(spark, monkeypatch):
    df = spark.createDataFrame(random_rows(250, 13), SCHEMA)
    cells = dedup.match_cells(dedup.match_classes(df), cliques=True)
    whole = sorted(map(tuple, dedup.scored_cell_pairs(cells).collect()))
    monkeypatch.setattr(dedup, "TILE_ROWS", 2)
    tiled = sorted(map(tuple, dedup.scored_cell_pairs(cells).collect()))
    assert whole == tiled and len(whole) > 20


def test_daily_visits_of_one_name_need_few_rounds(spark):
    start = dt.datetime(2023, 1, 1, 8)
    rows = [(2023, i, "awa diop", "Femme", 30, start + dt.timedelta(hours=23 * i)) for i in range(365)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    outcome = dedup.keep_first(dedup.match_classes(df))
    assert outcome.rounds <= 2
    assert {(r.annee, r.visit_no) for r in dedup.without_dropped(df, outcome).collect()} == scan(rows, 0.85)[0]


@pytest.mark.parametrize("cells,sent", [(1, 1), (3, 2), (12, 1), (40, 8)])
def test_small_buckets_decide_the_same(spark, monkeypatch, cells, sent):
    monkeypatch.setattr(dedup, "BUCKET_CELLS", cells)
    monkeypatch.setattr(dedup, "SENT", sent)
    check(spark, random_rows(150, 21 + cells, hot=True))


@pytest.mark.parametrize("threshold", [0.85, 0.78])
def test_phases_of_crowded_blocks_decide_the_same(spark, monkeypatch, threshold):
    """Visits that a kept visit of an earlier phase drops, dated or not, and their copies."""
    monkeypatch.setattr(dedup, "PHASE_CLASSES", 40)
    monkeypatch.setattr(dedup, "PHASE_GROWTH", 4)
    rows = random_rows(240, 61, hot=True)
    rows += [(y, i + 1000, *rest) for y, i, *rest in rows[:60]]
    check(spark, rows, threshold)


def test_pairs_of_a_crowded_block_are_not_all_listed(spark, monkeypatch):
    """600 names that all match, within 20 days: pairs are listed only between visits no earlier phase drops."""
    rng = random.Random(71)
    start = dt.datetime(2023, 1, 1)
    rows = [
        (2023, i, f"machinery customer{rng.randrange(10**6):09d}", "Femme", 30, start + dt.timedelta(hours=rng.randrange(24 * 20)))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(dedup, "PHASE_CLASSES", 80, raising=False)
    listed = []
    staged = dedup.staged

    def counted(part, label):
        out = staged(part, label)
        if label == "neighbours":
            listed.append(out.count())
        return out

    monkeypatch.setattr(dedup, "staged", counted)
    outcome = dedup.keep_first(dedup.match_classes(df))
    assert {(r.annee, r.visit_no) for r in dedup.without_dropped(df, outcome).collect()} == scan(rows, 0.85)[0]
    # Each pair stands there both ways; all at once they are 77,456.
    assert sum(listed) < 10_000, listed


def test_days_cut_in_windows_need_few_rounds(spark, monkeypatch):
    """Lookalikes over a year, in windows far smaller than the chain; rounds don't follow the calendar."""
    monkeypatch.setattr(dedup, "BUCKET_CELLS", 60)
    rng = random.Random(31)
    rows = [
        (2023, i, rng.choice(["awa diop", "awa diopp", "awa dieng", "awa sarr"]), "Femme", 30,
         dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 365)))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    outcome = dedup.keep_first(dedup.match_classes(df))
    assert outcome.rounds <= 15
    assert {(r.annee, r.visit_no) for r in dedup.without_dropped(df, outcome).collect()} == scan(rows, 0.85)[0]


def test_only_dropped_keys_are_carried(spark, capsys):
    df = spark.createDataFrame(random_rows(120, 41), SCHEMA)
    outcome = dedup.keep_first(dedup.match_classes(df))
    assert outcome.members.count() < df.count()
    dropped = dedup.dropped_visits(df, outcome)
    assert dropped.columns == ["annee", "block", "visit_no"]
    assert dropped.count() == df.count() - dedup.without_dropped(df, outcome, dropped).count() > 0


def test_ranks_of_far_row_numbers(spark):
    nos = [*range(1, 3000), 10**15, 10**15 + 1, 2 * 10**15, 9 * 10**17, 9 * 10**17 + 1]
    rows = spark.createDataFrame([(2023, b, n) for b in ("A", "B") for n in nos], "annee int, block string, no bigint")
    got = {(r.block, r.no): r.rank for r in dedup._ranks(rows).collect()}
    assert got == {(b, n): i + 1 for b in ("A", "B") for i, n in enumerate(nos)}


def test_sweep_holds_links_in_few_bytes():
    """200,000 links as a dictionary of tuples are over 50 MB."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from recordloom.operators import sweep

    n, around = 4000, 50
    number = np.arange(n)
    visits = pd.DataFrame({"year": np.full(n, 2023, "int32"), "cell": number, "no": number, "at": 0, "dated": True, "outside": sweep.LAST, "rest": sweep.LAST})
    others = (np.repeat(number, around) + np.tile(np.arange(-around // 2, around // 2) * 2 + 1, n)) % n
    links = pd.DataFrame({"year": np.full(n * around, 2023, "int32"), "cell": np.repeat(number, around), "other": others, "near": True, "far": False})
    tracemalloc.start()
    out = sweep.sweep(visits, links, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Links join odd numbers with even ones, so the first of two neighbours stays.
    assert len(out) == n and out["kept"].iloc[0] and 0 < out["kept"].sum() < n
    assert peak < 25e6
