import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import regex

from corvane.llm.forms import check, consistent_records, irregular, look_alike_groups, look_alikes, transducer


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (None, ""), ("", ""), (" ​　", ""), ("plain text", "plain text"), ("  two \t  blanks ", "two blanks"),
        ("Ｐｅ﻿ｖｉ （Ｃ​）", "Pevi (C)"), ("ｶﾞｲﾄﾞ", "ガイド"), ("ﬃx", "ffix"),
        ("é e​́ е́", "é é é"), ("\U0001d5ba\U0001d5bb", "ab"), ("ⅽⅰⅴ", "civ"), ("so­ft", "soft"),
        ("Сбopкa", "Cбopкa"), ("մօս", "մou"),
    ],
)
def test_same_look_same_form(text, form):
    t = transducer()
    assert t(text) == form
    assert t(form) == form


@pytest.mark.parametrize(("a", "b"), [("Abc", "abc"), ("e", "é"), ("o", "0"), ("l", "1"), ("x2", "x²"), ("H2O", "H₂O"), ("1/2", "½"), ("a b", "ab"), ("ß", "ss"), ("ⓐ", "a")])
def test_visible_differences_stay(a, b):
    assert transducer()(a) != transducer()(b)


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text(max_size=30))
def test_the_form_of_a_form_is_itself(text):
    t = transducer()
    assert t(t(text)) == t(text)


def test_conflicts_are_found():
    for bad in ({"a": "b", "b": "c"}, {"١": "l"}, {"а": "A"}):
        with pytest.raises(ValueError, match="form|differ"):
            check(bad)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("\u1112\u1161\u11ab\u1100\u1173\u11af", "한글"), ("\uffa1", "ㄱ"), ("\u1100", "ㄱ"), ("\U0002f800", "丽"), ("a\u200db", "ab"), ("a\u200cb", "ab"),
        ("a\u200b\u0301", "á"), ("\U0001f600\ufe0f", "\U0001f600"), ("❤\ufe0e", "❤"), ("1\ufe0f", "1"), ("日\ufe00", "日"),
    ],
)
def test_what_joins_or_shows_nothing_is_one(a, b):
    assert transducer()(a) == transducer()(b) == b


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("\U0001f469\u200d\U0001f469\u200d\U0001f467", "\U0001f469\U0001f469\U0001f467"), ("می\u200cروم", "میروم"), ("क्\u200dष", "क्ष"), ("क्\u200cष", "क्ष"),
        ("❤\ufe0f", "❤\ufe0e"), ("1\ufe0f\u20e3", "1\u20e3"), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4"), ("ㄱㅏ", "가"),
    ],
)
def test_joiners_and_selectors_that_show_stay(a, b):
    t = transducer()
    assert t(a) != t(b)
    assert t(t(a)) == t(a)


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text(st.characters(codec="utf-8"), max_size=20))
def test_regular_texts_are_their_own_form(text):
    own = regex.sub(" +", " ", text).strip(" ")
    if not irregular().search(own) and not (own.isascii() and not own.isprintable()):
        assert "".join(map(transducer().cluster, regex.findall(r"\X", own))) == own


COLS = "id long, title string, description string, form string"


def test_pairs_equal_brute_force(spark):
    t = transducer()
    titles = ["Map", "Мap", "Map ", "map", None, "", " "]
    rows = [(k, a, b, "x") for k, (a, b) in enumerate(itertools.product(titles, [None, "", "é", "é"]))] * 2
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    want = set()
    for x, y in itertools.combinations(rows, 2):
        if t(x[1]) == t(y[1]) and t(x[2]) == t(y[2]) and ((x[1] or "") != (y[1] or "") or (x[2] or "") != (y[2] or "")):
            want.add((x[0], y[0]))
    got = [tuple(r) for r in look_alikes(spark.createDataFrame(rows, COLS), "id", "title", "description").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_groups_cover_all_pairs(spark):
    rows = [(1, "Map", "d", ""), (2, "Мap", "d", ""), (3, "Map", "d", ""), (4, "Map", "other", ""), (5, "ｍap", "", ""), (6, "map", None, ""), (7, None, None, ""), (8, "", "\u200b", "")]
    df = spark.createDataFrame(rows, COLS)
    got = {r.id: (r.class_id, r.group_id) for r in look_alike_groups(df, "id", "title", "description").collect()}
    assert got == {1: (1, 1), 3: (1, 1), 2: (2, 1), 5: (5, 5), 6: (6, 5), 7: (7, 7), 8: (8, 7)}
    pairs = {(r.id_a, r.id_b) for r in look_alikes(df, "id", "title", "description").collect()}
    assert pairs == {(a, b) for a in got for b in got if a < b and got[a][1] == got[b][1] and got[a][0] != got[b][0]}


def test_hash_is_over_the_form(spark):
    df = spark.createDataFrame([(1, "ｍap", "a  b", ""), (2, None, "", "")], COLS)
    got = {r.id: bytes(r.metadata_hash) for r in consistent_records(df, "id", "title", "description").collect()}
    pre = lambda s: len(s.encode()).to_bytes(8, "big") + s.encode()
    assert got == {1: hashlib.sha256(pre("map") + pre("a b")).digest(), 2: hashlib.sha256(pre("") + pre("")).digest()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLS)
    assert look_alikes(empty, "id", "title", "description").count() == 0
    assert consistent_records(empty, "id", "title").count() == 0
