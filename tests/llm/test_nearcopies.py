import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import nearcopies
from corvane.llm.nearcopies import app_text, components, near_copy_groups, near_copy_pairs

COLS = "id long, text string, rep string"


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def brute(rows, threshold=0.7):
    sets = {k: words(t) for k, t, *_ in rows}
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=3, n=60):
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 9))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            rng.shuffle(w)
            rows.append((len(rows), " ".join(w), "c"))
    rows += [(9000, rows[0][1].upper(), "c"), (9001, rows[0][1], "c"), (9002, None, "c"), (9003, "", "c"), (9004, " - ", "c"), (9005, "solo", "c"), (9006, "Solo!", "c")]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in near_copy_pairs(spark.createDataFrame(rows, COLS), "id", F.col("text"), 0.7).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= brute(rows)
    assert len(set(got)) >= 0.98 * len(brute(rows))


def test_dense_regions_are_searched_too(spark, monkeypatch):
    """Many texts share most words, so every prefix is crowded and the regions grow orders of their own."""
    monkeypatch.setattr(nearcopies, "REGION", 4)
    base = " ".join(f"c{k}" for k in range(60))
    rows = [(k, f"{base} " + " ".join(f"u{k}x{j}" for j in range(k % 12)), "c") for k in range(70)]
    got = {tuple(r) for r in near_copy_pairs(spark.createDataFrame(rows, COLS), "id", F.col("text"), 0.7).collect()}
    want = brute(rows)
    assert got <= want
    assert len(got) >= 0.98 * len(want), len(got) / len(want)


def test_copies_are_compared_in_blocks(spark, monkeypatch):
    """Texts that share nearly all words stay dense in every order, and labels are shared by more records than a task holds."""
    monkeypatch.setattr(nearcopies, "REGION", 3)
    monkeypatch.setattr(nearcopies, "SPLIT", 2)
    base = " ".join(f"c{k}" for k in range(400))
    rows = [(k, f"{base} u{k}", "c") for k in range(60)] + [(100 + k, base, "c") for k in range(7)] + [(200 + k, f"other text {k}", "c") for k in range(5)]
    got = [tuple(r) for r in near_copy_pairs(spark.createDataFrame(rows, COLS), "id", F.col("text"), 0.7).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_regions_are_as_deep_as_they_are_crowded(monkeypatch):
    monkeypatch.setattr(nearcopies, "REGION", 2)
    label = np.array([0x001002003004005, 0x001002003004005, 0x001002003004006, 0x001002009000000, 0x001002009000001, 0x001002009000001, 0x001002009000001, 0x005000000000000, 0x005000000000001])
    region, dense = nearcopies._regions(np.zeros(9, np.int64), label, np.zeros(9, int), 3, 5)
    assert dense.tolist() == [False] * 4 + [True] * 3 + [False] * 2
    groups = [region[:2].tolist(), region[7:].tolist()]
    assert all(len({*g}) == 1 for g in groups)
    assert len({*region[[0, 2, 3, 7]].tolist()}) == 4
    crowd = np.full(9, 1)
    region, _ = nearcopies._regions(np.zeros(9, np.int64), label, crowd, 3, 5)
    assert region[7] != region[8]
    assert nearcopies._regions(np.zeros(9, np.int64), label, np.full(9, 2), 3, 5)[1].all()


def test_near_pairs_within_regions():
    sketch = np.zeros((6, 3), np.int64)
    sketch[2] = -1
    a, b = nearcopies._near(np.array([0, 0, 0, 4, 4, 7]), sketch, 50)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (3, 4)]
    assert [len(x) for x in nearcopies._near(np.zeros(0, np.int64), sketch[:0], 50)] == [0, 0]


def test_groups_are_components(spark):
    rows = corpus(5, 40)
    got = {r.id: (r.group, r.links) for r in near_copy_groups(spark.createDataFrame(rows, COLS), "id", F.col("text"), 0.7).collect()}
    want = {}
    for a, b in sorted(brute(rows)):
        ga, gb = want.get(a, a), want.get(b, b)
        for k in [k for k, g in want.items() if g in (ga, gb)] + [a, b]:
            want[k] = min(ga, gb)
    assert {k: g for k, (g, _) in got.items()} == want


def test_a_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "id_a long, id_b long")
    assert {r.id: r.group for r in components(chain).collect()} == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_apps_take_the_heaviest_snippet(spark):
    apps = spark.createDataFrame([(1, "k", "T", "D"), (2, "k", "", "D"), (3, "k", "T", None), (4, "z", "T", "D")], "app_id long, contract_key string, title string, description string")
    variants = spark.createDataFrame([(1, "k", "light", 1), (2, "k", "heavy", 9), (1, "k", "light", 1)], "variant_id long, contract_key string, mini_snippet string, total_weight long")
    assert {r.app_id: r.text for r in app_text(apps, variants).collect()} == {1: "T D heavy", 2: None, 3: None, 4: "T D "}


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLS)
    assert near_copy_pairs(empty, "id", F.col("text"), 0.7).count() == 0
    assert near_copy_groups(empty, "id", F.col("text"), 0.7).count() == 0
