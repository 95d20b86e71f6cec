import random
import math
import re
from collections import Counter

import pytest

from corvane.llm.common import current
from corvane.llm import distinctive
from corvane.llm.distinctive import distinctive_cases, distinctive_terms, scored_cases, significant_terms
from corvane.llm.survivors import app_survivors, surviving_records

RECORDS = [
    (1, "k1", "Pump pump PUMP valve", "of the", None),
    (2, "k2", "valve", "pump; pump, pump!", "the the"),
    (3, "k3", None, "", None),
    (4, None, "crêpe abc abc abc", "the", "x"),
    (5, "k1", "Pump pump PUMP valve", "of the", None),
]
COLS = "id long, grp string, a string, b string, c string"


def brute(rows):
    terms = {r[0]: [t for t in re.split(r"[\s!-/:-@\[-`{-~]+", " ".join(x or "" for x in r[2:5]).lower()) if t] for r in rows}
    n, total = sum(map(len, terms.values())), Counter(t for ts in terms.values() for t in ts)
    out = {}
    for r in rows:
        for t, k in Counter(terms[r[0]]).items():
            cells = [k, total[t] - k, len(terms[r[0]]) - k, n - total[t] - len(terms[r[0]]) + k]
            rows_, cols = [cells[0] + cells[1], cells[2] + cells[3]], [cells[0] + cells[2], cells[1] + cells[3]]
            g2 = 2 * sum(o * math.log(o * n / (rows_[i // 2] * cols[i % 2])) for i, o in enumerate(cells) if o)
            out[r[0], t] = (k, total[t], len({x[1] for x in rows if t in terms[x[0]]}), -g2 if k * n < rows_[0] * cols[0] else g2)
    return out


def test_scores_equal_a_plain_count(spark):
    df = spark.createDataFrame([(*r, "noise", 1.0) for r in RECORDS], COLS + ", term string, score double")
    got = {(r.id, r.term): (r.tf, r.total_tf, r.groups, r.score) for r in distinctive_terms(df, "id", "grp", "a", "b", "c").collect()}
    want = brute(RECORDS)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:3] == w[:3]
        assert got[k][3] == pytest.approx(w[3], abs=1e-9)


def test_cases_need_count_groups_and_letters(spark):
    df = spark.createDataFrame(RECORDS, COLS)
    assert {tuple(r) for r in distinctive_cases(df, "id", "grp", "a", "b", "c").collect()} == {(1, "pump"), (2, "pump"), (5, "pump")}


def test_cases_go_by_counts_where_the_term_is_rarer_than_elsewhere(spark):
    long = "pump pump pump " + " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, "k1", long, None, None), *((k, "k2", "pump pump pump", None, None) for k in range(2, 8))], COLS)
    assert {r.score < 0 for r in distinctive_terms(df, "id", "grp", "a", "b", "c").where("id = 1 AND term = 'pump'").collect()} == {True}
    assert {tuple(r) for r in distinctive_cases(df, "id", "grp", "a", "b", "c").collect()} == {(k, "pump") for k in range(1, 8)}


def test_no_rows_no_terms(spark):
    assert distinctive_terms(spark.createDataFrame([], COLS), "id", "grp", "a", "b").count() == 0
    assert distinctive_cases(spark.createDataFrame([], COLS), "id", "grp", "a", "b").count() == 0
    one = distinctive_terms(spark.createDataFrame([(1, "k", "a a b", "", None)], COLS), "id", "grp", "a", "b", "c")
    assert {(r.term, r.score) for r in one.collect()} == {("a", 0.0), ("b", 0.0)}


def test_a_long_text_is_read_whole(spark):
    df = spark.createDataFrame([(1, "a", "word " * 100_000 + "tail", "", ""), (2, "b", "other", "", "")], COLS)
    got = {r.term: r.tf for r in distinctive_terms(df, "id", "grp", "a").where("id = 1").collect()}
    assert got == {"word": 100_000, "tail": 1}


APPS = "app_id long, contract_key string, title string, description string, first_seen long, last_seen long, size_bytes long, subscribers long, version long"
VARIANTS = "variant_id long, contract_key string, title string, total_weight long, size_bytes long"


def test_current_takes_the_latest_and_one_of_copies(spark):
    rows = [(1, "k", "old", None, 1, 5, 1, 0, 1), (1, "k", "new", None, 1, 9, 1, 0, 1), (1, "k", "new", None, 1, 9, 1, 0, 1), (2, None, None, None, None, None, None, None, None)]
    got = {(r.app_id, r.title) for r in current(spark.createDataFrame(rows, APPS), "app_id", "last_seen").collect()}
    assert got == {(1, "new"), (2, None)}


def test_survivors_field_by_field(spark):
    apps = [
        (5, "a", " Maps ", "", 1, 1, 10, 0, None),
        (3, "b", "maps", "good", 1, 1, None, 0, 7),
        (4, "c", "MAPS ", "better", 1, 1, 10, 0, 7),
        (9, "a", "maps2", None, 1, 1, None, 0, None),
        (8, "a", "Maps2", None, 1, 1, None, 0, None),
        (10, "a", "", "x", 1, 1, 1, 0, 1), (11, "a", "  ", "x", 1, 1, 1, 0, 1), (12, "a", None, "x", 1, 1, 1, 0, 1), (13, "a", "alone", "x", 1, 1, 1, 0, 1),
    ]
    variants = spark.createDataFrame([(1, "a", "t", 100, 1), (2, "b", "t", 5, 1), (3, "c", "t", 2, 1), (4, "c", "t", 3, 1)], VARIANTS)
    apps = spark.createDataFrame(apps, APPS)
    got = {tuple(r) for r in app_survivors(apps, variants).collect()}
    # b and c weigh 5 each; c has a size, so it is the record; equal sizes and versions go to the smaller id.
    assert got == {(3, "record", 4), (3, "description", 3), (3, "size_bytes", 4), (3, "version", 3), (8, "record", 8)}
    built = {r.group_app_id: (r.description, r.size_bytes, r.version) for r in surviving_records(apps, variants).collect()}
    assert built == {3: ("good", 10, 7), 8: (None, None, None)}


def test_no_apps_no_groups(spark):
    assert app_survivors(spark.createDataFrame([], APPS), spark.createDataFrame([], VARIANTS)).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_cases_are_those_of_all_scores(spark, monkeypatch, most):
    """Whether the terms are broadcast or joined, terms of very many groups and a hot group included."""
    monkeypatch.setattr(distinctive, "MOST_TERMS", most)
    rng = random.Random(8)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("rk", "nt", "ll")]
    rows = [(k, None if k % 17 == 0 else "hot" if k % 3 == 0 else f"key{k % 90}", " ".join(rng.choices(words[: 10 + k % 50], k=40)), f"rare{'abcdefghij'[k % 10]} " * (k % 5), None) for k in range(300)]
    df = spark.createDataFrame(rows, COLS)
    every = distinctive_terms(df, "id", "grp", "a", "b", "c")
    want = {(r.id, r.term): (r.tf, r.record_terms, r.total_tf, r.groups, r.score) for r in every.where("tf >= 3 AND groups BETWEEN 2 AND 30 AND term RLIKE '^[a-z]{4,}$'").collect()}
    got = scored_cases(df, "id", "grp", "a", "b", "c", groups=(2, 30)).collect()
    assert len(got) == len({(r.id, r.term) for r in got})
    assert {(r.id, r.term): (r.tf, r.record_terms, r.total_tf, r.groups, r.score) for r in got} == want
    assert len(want) > 20
    assert {r.score > 10.83 for r in significant_terms(every).collect()} == {True}


@pytest.mark.parametrize("most", [0, 200_000])
def test_cases_are_counted_without_scores(spark, monkeypatch, most):
    """No score is computed and nothing is written that only a score needs; the cases are those of a plain count."""
    written = []
    monkeypatch.setattr(distinctive, "MOST_TERMS", most)
    monkeypatch.setattr(distinctive, "log_likelihood", lambda *_: pytest.fail("cases have no score in them"))
    materialize = distinctive.materialize
    monkeypatch.setattr(distinctive, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    rng = random.Random(3)
    words = ["pump", "valve", "hose", "abc", "w3", "crêpe", "the", "seal", "gear", "bolt"]
    rows = [(k, None if k % 11 == 0 else f"key{k % 13}", " ".join(rng.choices(words[: 3 + k % 8], k=9)), f"rare{'abcdefg'[k % 7]} " * (k % 5), None) for k in range(60)]
    got = [tuple(r) for r in distinctive_cases(spark.createDataFrame(rows, COLS), "id", "grp", "a", "b", "c").collect()]
    want = {key for key, (tf, _, groups, _) in brute(rows).items() if tf >= 3 and 2 <= groups <= 8 and re.fullmatch("[a-z]{4,}", key[1])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert [set(df.columns) for df in written] == [{"term"}, {"_id", "_group", "term", "tf"}]
    assert {r.term for r in written[0].collect()} >= {term for _, term in want}
    assert not {r.term for r in written[0].collect()} & {"abc", "w3", "crêpe", "the"}


def test_texts_are_cut_once(spark):
    df = spark.createDataFrame(RECORDS, COLS)
    plan = distinctive._records(df, "id", "grp", "a", "b", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert {r._id for r in distinctive._records(df, "id", "grp", "a", "b", "c").collect()} == {1, 2, 4, 5}
