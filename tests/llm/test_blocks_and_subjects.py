import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from corvane.llm.blocks import Counts, Features, Labeller, agreed, blocks_of, count_over, cue, fit_labeller, label_blocks, load_labeller, main_content, page_blocks, save_labeller, tongue_of, votes_of
from corvane.llm import subjects
from corvane.llm.forms import altered, transducer
from corvane.llm.subjects import Lexicon, fit_lexicon, grow_lexicon, learn, subject_posteriors, subjects_found

CONTENT = ["The makers care about guild archives more than about pilgrim roads.", "Print any page of treaties with one tap.", "Old fortresses can be moved to the shelf.", "* 12 pottery shards", "Short version: Three editors check all census rolls for errors."]
FURNITURE = ["Back to top", "Home | About | Search | Help", "© 2015 Kelafofi collective. All rights reserved.", "We use cookies to improve your visit. Accept all Reject Settings", "Advertisement", "Sign up for our newsletter and never miss an update."]
PAGES = "page_id long, description string, snippet string, line string"


def pages(n=160, seed=2):
    rng, rows, truth = random.Random(seed), [], {}
    for k in range(n):
        lines = [(rng.choice(FURNITURE), True) for _ in range(rng.randint(0, 2))] + [(rng.choice(CONTENT), False) for _ in range(rng.randint(1, 6))] + [(rng.choice(FURNITURE), True) for _ in range(rng.randint(0, 3))]
        rows.append((k, rng.choice([None, "", CONTENT[0], FURNITURE[3]]), "\r\n".join(x for x, _ in lines) + "\n \n", "clash"))
        truth |= {(k, n): f for n, (_, f) in enumerate(lines, 1)}
        if rows[-1][1]:
            truth[k, 0] = rows[-1][1] == FURNITURE[3]
    return rows, truth


def test_gradient_is_the_slope():
    rows, _ = pages(6)
    found = [blocks_of(r[1], r[2]) for r in rows]
    f, y = Features(found), np.array([cue(x) for p in found for _, x in p], np.float64)
    m = Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}

    def loss():
        p = m.probabilities(f)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in m.gradient(f, y).items():
        flat, at = m.w[name].reshape(-1), int(np.abs(g).argmax())
        was = flat[at]
        flat[at] = was + 1e-4
        up = loss()
        flat[at] = was - 1e-4
        slope = (up - loss()) / 2e-4
        flat[at] = was
        assert slope == pytest.approx(g.reshape(-1)[at], rel=1e-2, abs=1e-6)


def test_blocks_are_told_apart(spark):
    rows, truth = pages()
    df = page_blocks(spark.createDataFrame(rows, PAGES), "page_id", "page_id")
    fitted = fit_labeller(df)
    got = {(r.page_id, r.line_no): r.furniture >= 0.5 for r in label_blocks(df, "page_id", fitted).collect()}
    assert got.keys() == truth.keys()
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.97
    clean = {r.page_id: r for r in main_content(df, "page_id", fitted).collect()}
    assert clean.keys() == {r[0] for r in rows}
    assert all("Back to top" not in (r.snippet or "") and "\r" not in (r.snippet or "") for r in clean.values())


def test_pages_without_blocks(spark):
    df = page_blocks(spark.createDataFrame([(1, None, None, "x"), (2, "", "\n \r\n​", "x")], PAGES), "page_id", "line")
    assert fit_labeller(df) is None
    assert label_blocks(df, "page_id", None).count() == 0
    assert {tuple(r) for r in main_content(df, "page_id", None).collect()} == {(1, None, None), (2, None, None)}
    assert main_content(df.limit(0), "page_id", None).count() == 0


def test_context_reaches_both_ways():
    m = Labeller(3)
    base = [[(1, "one"), (2, "two"), (3, "three")]]
    p = m.probabilities(Features(base))
    assert m.probabilities(Features([[(1, "other"), (2, "two"), (3, "three")]]))[2] != p[2]
    assert m.probabilities(Features([[(1, "one"), (2, "two"), (3, "else")]]))[0] != p[0]
    both = m.probabilities(Features([*base, [(1, "a b"), (2, "c"), (3, "d"), (4, "e"), (5, "f")]]))
    assert both[:3] == pytest.approx(p, abs=1e-6)


NOUNS = {"food": ["marinades", "dumplings", "salads", "soups"], "law": ["notaries", "treaties", "appeals", "statutes"]}
TALK = ["That is all for today.", "See you around.", "More on that tomorrow."]


def document(rng, subject, other=None, of=10):
    s = [f"Readers asked for {rng.choice(NOUNS[subject])} and {rng.choice(NOUNS[subject])} again." for _ in range(of)] if subject else []
    s += [f"Readers asked for {rng.choice(NOUNS[other])} again."] if other else []
    s += [rng.choice(TALK) for _ in range(3)]
    rng.shuffle(s)
    return " ".join(s)


def test_subjects_of_documents(spark):
    rng, docs, truth, labels = random.Random(4), [], set(), []
    for k in range(300):
        subject = ["food", "law", None][k % 3]
        other = {"food": "law", "law": "food"}.get(subject) if k % 5 == 0 else None
        docs.append((k, document(rng, subject, other, 11), "review" if k % 2 else None, f"key{k % 7}", "clash"))
        if subject:
            truth.add((k, subject))
            if k % 4 == 1 or k % 4 == 2:
                labels.append((k, subject if k % 13 else "food"))
    docs += [(1000, None, None, None, ""), (1001, "", "", "", ""), (1002, " \n ", "", "", ""), (1003, "# marinades", "", "", ""), (1004, "## 4.12.4\n- READERS ASKED FOR MаRINＡDES AGAIN.\n- See you around.", "", "", "")]
    truth.add((1004, "food"))
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, contract_key string, share string")
    lab = spark.createDataFrame([*labels, (1, None), (2, "unknown"), (999999, "law")], "doc_id long, subject string")
    areas = spark.createDataFrame([("law", "x"), ("food", "y")], "subject string, about string")
    apps = spark.createDataFrame([(1, "key1", "Marinades", None), (2, None, None, None)], "app_id long, contract_key string, title string, description string")
    assert {tuple(r) for r in subjects_found(d, lab, areas, apps).collect()} == truth
    assert subject_posteriors(d.limit(0), lab, areas, apps).count() == 0
    assert subject_posteriors(d, lab.limit(0), areas, apps).count() == 0


def test_the_lexicon_grows_over_texts_without_labels(spark):
    rng = random.Random(9)
    seeds, unseen = ["marinades", "dumplings", "notaries", "treaties"], {"marinades": "teigtaschen", "notaries": "urkunden"}
    docs = []
    for k in range(120):
        food = k % 2 == 0
        known = seeds[:2] if food else seeds[2:]
        words = [rng.choice(known) for _ in range(4)] + [unseen[known[0]]] * 2
        docs.append((k, " ".join(f"Readers asked for {w} again." for w in words) + " That is all for today."))
    docs += [(1000 + k, "Readers asked for teigtaschen again.") for k in range(3)] + [(2000, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(w, 30, [30, 0] if w in seeds[:2] else [0, 30]) for w in seeds]
    lexicon = grow_lexicon(d, Lexicon(rows, ["food", "law"], [0.5, 0.5]))
    assert {w: k for w, (k, _) in lexicon.word.items()} == {"marinades": 0, "dumplings": 0, "teigtaschen": 0, "notaries": 1, "treaties": 1, "urkunden": 1}
    assert lexicon.read(docs[-2][1])[0][:2] == (0, 1.0)
    assert not grow_lexicon(d.limit(0), Lexicon([], ["food", "law"], [0.5, 0.5])).word


@pytest.mark.parametrize("sent", [1, 2, 50_000])
def test_all_grown_words_count_however_many(spark, monkeypatch, sent):
    seeds, unseen = {"food": ["marinades", "dumplings"], "law": ["notaries", "treaties"]}, {"food": ["teigtaschen", "suppen"], "law": ["urkunden", "verfahrens" * 7]}
    docs = []
    for k in range(160):
        subject = "food" if k % 2 else "law"
        words = [*seeds[subject] * 2, *[unseen[subject][k % 10 > 6]] * 2]
        docs.append((k, " ".join(f"Readers asked for {w} again." for w in words), "review", "key"))
    known_by_one_word = [(1000 + 10 * i + k, f"Leser fragten nach {w} {k}.", None, "") for i, w in enumerate(w for s in unseen for w in unseen[s]) for k in range(2)]
    d = spark.createDataFrame([*docs, *known_by_one_word, known_by_one_word[0], (2000, None, None, None)], "doc_id long, text string, source string, contract_key string")
    apps = spark.createDataFrame([(1, "key", "Suppen heute", None)], "app_id long, contract_key string, title string, description string")
    rows = [(w, 30, [30, 0] if s == "food" else [0, 30]) for s in seeds for w in seeds[s]]
    monkeypatch.setattr(subjects, "MOST_GROWN", sent)
    lexicon = grow_lexicon(d, Lexicon(rows, ["food", "law"], [0.5, 0.5]))
    found = subjects.votes(d, apps, lexicon)
    assert {(r.doc_id, r.k) for r in found.where("doc_id >= 1000").collect()} == {(i, int(i >= 1020)) for i, *_ in known_by_one_word}
    assert {(r.k, r.adr) for r in found.where("doc_id < 1000").collect()} == {(0, 2), (1, 1)}
    assert found.count() == 169


def test_furniture_is_about_nothing():
    x = Lexicon([("privacy", 40, [38, 2]), ("terms", 40, [2, 38])], ["law", "finance"], [0.5, 0.5])
    assert x.sentence("terms of use privacy imprint".split()) == -1
    assert x.sentence("home boards contact log in terms of use privacy".split()) == -1
    assert x.sentence("readers asked for privacy complaints".split()) == 0


def test_run_together_items_are_furniture_in_long_sentences():
    x = Lexicon([("marinades", 40, [38, 2])], ["food", "law"], [0.5, 0.5])
    listed = "homeboardscontact searchsettingshelp aboutarchiveblog downloadfaqgallery membersnewssearch helpcontactabout"
    assert x.sentence(f"{listed} marinades".split()) == -1
    assert x.sentence(f"{listed} readers asked for marinades with dumplings and other dishes".split()) == 0


def test_every_unclean_character_is_read_in_the_consistent_form():
    for c in "\u0131\u0251\u0261\u061c\u180e\u3164\u115f\xad\u200b\u0430\uff4e\U0001d41a":
        assert subjects.readable(f"mar{c}nades") == transducer()(f"mar{c}nades") != f"mar{c}nades"
    words = lambda text: [w for _, lines in subjects.lines_of(text) for line in lines for w in line]
    for at in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]:
        text = f"ab{chr(at)}cd"
        if subjects.readable(text) == text:
            assert words(transducer()(text)) == words(text), hex(at)


def plain_lines(text):
    """What `lines_of` gives, as it is defined: by the form of whole lines and expressions for words and sentences' ends."""
    if not text.isascii() and altered().search(text):
        text = "\n".join(map(transducer(), text.split("\n")))
    lines = [(line.lstrip().startswith("#"), [w for s in re.split(r"(?<=[.!?…])\s+", line) if (w := re.findall(r"[^\W\d_]+", s))]) for line in text.lower().split("\n")]
    return [x for x in lines if x[1]]


def test_lines_are_as_defined():
    rng = random.Random(3)
    signs = [*"aAzZß9_.!?…#-'|\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\u200b\u200d\ufe0f\u0301\u0308\u0e33\uff9e각İΣσéñ中²½ªа．", *" " * 12, *[". "] * 4, "\u1112", "\u1161", "\U0001f468"]
    every = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x20000))]
    for k in range(10_000):
        text = "".join(" " if rng.random() < k % 2 / 2 else rng.choice(signs if rng.random() < 0.8 else every) for _ in range(rng.randint(0, 40)))
        assert list(subjects.lines_of(text)) == plain_lines(text), ascii(text)
    many = "".join(map(chr, range(0x2000, 0x2C00)))
    assert list(subjects.lines_of(f"# One… two\n{many} three. four")) == plain_lines(f"# One… two\n{many} three. four")


def test_only_parts_with_altered_characters_are_formed(monkeypatch):
    formed = []
    monkeypatch.setattr(subjects, "transducer", lambda: lambda x: formed.append(x) or transducer()(x))
    assert list(subjects.lines_of("# Été\nReaders asked for mаrinades. – We did!")) == [(True, [["été"]]), (False, [["readers", "asked", "for", "marinades"], ["we", "did"]])]
    assert formed == ["mаrinades."]


def test_lines_cost_less_than_expressions_do():
    rng = random.Random(6)
    texts = ["\n".join(document(rng, rng.choice(["food", "law"])) + " – él, 1984." * (k % 2) for _ in range(3)) for k in range(300)]

    def seconds(f):
        times = []
        for _ in range(7):
            began = time.process_time()
            for x in texts:
                list(f(x))
            times.append(time.process_time() - began)
        return min(times)

    plain_lines(texts[1]), list(subjects.lines_of(texts[1]))
    assert seconds(subjects.lines_of) < 0.75 * seconds(plain_lines)


def test_tallies_give_equal_parts():
    terms, rows = subjects.tallied({(0,): Counter(a=2, b=1), (0, 1): Counter(a=1)}, 2)
    assert dict(zip(terms, rows.T.tolist(), strict=True)) == {"a": [2.5, 0.5, 3], "b": [1, 0, 1]}
    terms, rows = subjects.tallied({}, 2)
    assert terms == []
    assert rows.shape == (3, 0)


def test_labels_are_bounded_by_hash(spark):
    d = spark.createDataFrame([(k, "marinades dumplings") for k in range(50)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, "food") for k in range(50)], "doc_id long, subject string")
    lexicon = fit_lexicon(d, lab, ["food"], most=2)
    assert not lexicon.word  # two documents are too few for a term


def test_the_model_learns_which_vote_to_trust():
    rng = np.random.default_rng(1)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.6
        lex = (5 if y else int(rng.integers(2))) if rng.random() < 0.9 else (1 if y else 5)
        good, noise = 1 + int(y if rng.random() < 0.95 else not y), int(rng.integers(2))
        if rng.random() < 0.1:
            good = 0
        patterns[lex, good, noise] = patterns.get((lex, good, noise), 0) + 1
    p = learn(sorted(patterns.items()))
    assert p[5, 2, 0] > 0.9
    assert p[5, 2, 0] > p[5, 1, 0] + 0.2
    assert p[1, 2, 0] > p[1, 1, 0] + 0.1
    assert p[1, 1, 0] < p[1, 0, 0] < p[1, 2, 0]
    assert abs(p[5, 2, 0] - p[5, 2, 1]) < 0.1
    assert learn([]) == {}


def test_headings_vote_by_their_own_words():
    x = Lexicon([("marinades", 40, [38, 2]), ("treaties", 40, [2, 38])], ["food", "law"], [0.5, 0.5])
    body = "We like marinades a lot. We sign treaties too."
    assert [r[:3] for r in x.read(body)] == [(0, 0.5, 0), (1, 0.5, 0)]
    assert [r[:3] for r in x.read(f"# Marinades today\n{body}")] == [(0, 0.5, 2), (1, 0.5, 1)]
    assert [r[:3] for r in x.read(f"# Notes\n{body}")] == [(0, 0.5, 0), (1, 0.5, 0)]


@pytest.mark.parametrize("most", [1, 20_000])
def test_every_source_has_its_own_vote(spark, monkeypatch, most):
    rng, docs = random.Random(5), []
    for k in range(1200):
        source = f"source {k % 100}" if k % 7 else None
        docs.append((k, document(rng, ["food", "law"][k % 2], ["law", "food"][k % 2] if k % 3 else None, 1 + k % 11), source, ""))
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, contract_key string")
    labels = spark.createDataFrame([(k, ["food", "law"][k % 2]) for k in range(400)], "doc_id long, subject string")
    areas = spark.createDataFrame([("law",), ("food",)], "subject string")
    apps = spark.createDataFrame([], "contract_key string, title string, description string")
    monkeypatch.setattr(subjects, "MOST_PATTERNS", most, raising=False)
    got = {(r.doc_id, r.subject): r.posterior for r in subject_posteriors(d, labels, areas, apps).collect()}
    found = subjects.votes(d, apps, grow_lexicon(d, fit_lexicon(d, labels, ["food", "law"]))).collect()
    own = {i: str(source) for i, _, source, _ in docs}
    patterns = {}
    for r in found:
        p = (r.lex, r.sec, r.adr, own[r.doc_id])
        patterns[p] = patterns.get(p, 0) + 1
    p = learn(sorted(patterns.items()))
    assert len({r.src for r in found}) == 101
    assert got == pytest.approx({(r.doc_id, ["food", "law"][r.k]): p[r.lex, r.sec, r.adr, own[r.doc_id]] for r in found}, abs=1e-6)


def test_ambiguous_words_need_their_neighbour():
    rows = [("scores", 40, [20, 20]), ("orchestra scores", 20, [19.5, 0.5]), ("match", 20, [0.5, 19.5])]
    x = Lexicon(rows, ["music", "sport"], [0.5, 0.5])
    assert x.sentence(["orchestra", "scores"]) == 0
    assert x.sentence(["scores"]) == -1
    assert x.sentence(["match", "scores"]) == 1


def matter_pages(n=300, seed=5):
    """Pages each about one of ten matters; the furniture begins with no common phrase, and stands under many keys."""
    rng, rows, truth = random.Random(seed), [], {}
    matters = [[f"{c}{v}rk{x}n" for v in "aeio" for x in "aeiou"] for c in "bdfgklmprt"]
    for k in range(n):
        own = rng.choice(matters)
        lines = [("Mitmachen · Rezensionen · Hilfe · Suche", True), ("Dernière modification, imprimer ou copier la page", True)][: rng.randint(0, 2)]
        lines += [(f"The {rng.choice(own)} and the {rng.choice(own)} of {rng.choice(own)} from {rng.choice(own)} were seen in year {rng.randint(1, 99)}.", False) for _ in range(rng.randint(3, 7))]
        lines += [("This site stores what the visitors of the page like", True), ("Back to top", True)][: rng.randint(0, 2)]
        rows.append((k, None, "\n".join(x for x, _ in lines), f"key{k}"))
        truth |= {(k, i): f for i, (_, f) in enumerate(lines, 1)}
    return rows, truth


def test_furniture_of_no_listed_wording_is_learned_from_counts(spark):
    rows, truth = matter_pages()
    df = page_blocks(spark.createDataFrame(rows, PAGES), "page_id", "line")
    got = {(r.page_id, r.line_no): r.furniture >= 0.5 for r in label_blocks(df, "page_id", fit_labeller(df), lines=False).collect()}
    forms = {(k, n): form for k, _, snippet, _ in rows for n, form in blocks_of(None, snippet)}
    unlisted = [at for at, is_ in truth.items() if is_ and not cue(forms[at])]
    assert len(unlisted) > 200
    assert np.mean([got[at] for at in unlisted]) > 0.95
    assert np.mean([got[at] for at, is_ in truth.items() if not is_]) < 0.02


def test_counts_go_over_all_pages(spark):
    rows = [(1, None, "The stone\nThe stone again", "a"), (2, None, "the stone", "b"), (3, None, "Menu", None), (4, None, "Menu", "a"), (5, None, "menu", "b"), (6, "x", None, "b")]
    df = page_blocks(spark.createDataFrame(rows, PAGES).repartition(3), "page_id", "line")
    counts = count_over(df, [[(1, "the stone"), (2, "menu")]])
    assert counts == Counts({"en": 2, "": 4}, {("en", ""): (2, 0), ("", ""): (4, 0), ("en", "the"): (2, 1), ("en", "stone"): (2, 1), ("", "menu"): (3, 0)}, {"the stone": 2, "menu": 2})
    assert tongue_of(["Der Stein und die Bank"]) == "de"
    assert tongue_of(["12"]) == ""


def test_votes_agree_on_hidden_answers():
    page = [(0, "A page."), (1, "Back to top"), (2, "* 12")]
    votes = votes_of(page, Counts({}, {}, {}))
    assert [v[0] for v in votes] == [0, 4, 0]
    assert [v[4] for v in votes] == [0, 1, 2]
    p = agreed(np.array(votes * 5))
    assert p.shape == (15,)
    assert p[1] > p[0]


def test_a_labeller_is_kept(spark, tmp_path):
    rows, _ = pages(40)
    df = page_blocks(spark.createDataFrame(rows, PAGES), "page_id", "line")
    fitted = fit_labeller(df)
    save_labeller(spark, fitted, str(tmp_path / "labeller"))
    kept = load_labeller(spark, str(tmp_path / "labeller"))
    answers = [sorted(tuple(r) for r in label_blocks(df, "page_id", m).collect()) for m in (fitted, kept)]
    assert answers[0] == answers[1]
