import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.mixture import mixture, packets, shares
from corvane.llm.tokens import VOCABULARY, Encoded, encode_corpus, encoder, token_count

ODD = " \n\t ab'stre1é漢字́\U0001f389.,-<|endoftext|>　 lL"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    texts += ["".join(rng.choice("aehinstor") for _ in range(rng.randint(1, 20))) for _ in range(4000)]
    texts += [(w * 40)[:n] for w in ("a", "ab", "=", "-", "0", "ha", " ") for n in range(1, 70, 3)]
    texts += ["I'll  say\r\n\r\n 'tis  ", " leading", "trailing ", "<|endoftext|>", "x" * 50_000]
    e = encoder()
    assert [e.encode(t) for t in texts] == [library(t) for t in texts]


def test_appends_and_edits_equal_encoding_anew(library):
    rng, doc = random.Random(6), Encoded(encoder())
    for _ in range(1500):
        s = doc.text
        at, ins = rng.randint(0, len(s)), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5)))
        rem = rng.randint(0, min(4, len(s) - at))
        doc.edit(at, rem, ins) if rng.random() < 0.7 else doc.append(ins)
        want = (s[:at] + ins + s[at + rem :], s + ins)
        assert doc.text in want
        assert doc.ids == library(doc.text)
        if len(doc.text) > 80:
            doc = Encoded(encoder())


def test_rows_of_all_kinds(spark, library):
    rows = [(1, "Hello world", "keep"), (2, None, None), (3, "", "x"), (4, "Hello world", "keep"), (5, " ", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_corpus(df)
    assert out.columns == ["doc_id", "text", "ids"]
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {1: library("Hello world"), 2: [], 3: [], 4: library("Hello world"), 5: library(" ")}
    assert {r.doc_id: r.n for r in df.select("doc_id", token_count(F.col("text")).alias("n")).collect()} == {k: len(v) for k, v in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


DOCS = "doc_id long, text string, source string, position string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(1, 30))), "big" if k % 4 else "mid", "p") for k in range(1200)]
    rows += [(2000 + k, f"small text {k} of few", "small", "p") for k in range(40)]
    rows += [(3000, rows[1][1], "big", "p"), (3001, rows[1][1], "small", "p"), (3002, None, "big", "p"), (3003, "", "mid", "p"), (3004, "no source", None, "p"), (3005, "other", "untargeted", "p")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_shares_are_reached_and_repeats_kept(spark, corpus):
    rows, docs = corpus
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.15, 3), ("absent", 0.05, 4)], TARGETS)
    queue = packets(docs, targets)
    mixed = mixture(queue)
    taken = mixed.collect()
    text = {r[0]: r[1] for r in rows}
    uses = {}
    for r in taken:
        uses[text[r.doc_id]] = uses.get(text[r.doc_id], 0) + 1
        assert uses[text[r.doc_id]] <= {"big": 1, "mid": 1, "small": 3}[r.source]
    assert sorted(r.position for r in taken) == [sum(x.n_tokens for x in sorted(taken, key=lambda x: x.position)[:k]) for k in range(len(taken))]
    got = {r.source: r for r in shares(mixed, queue, targets).collect()}
    assert got["absent"].tokens == 0
    largest, total = max(r.n_tokens for r in taken), sum(r.n_tokens for r in taken)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert got[s].share == pytest.approx(w / 0.95, abs=2 * largest / total + 0.002)
    assert got["small"].most_copies == 3


def test_a_larger_budget_takes_everything_and_says_so(spark, corpus):
    _, docs = corpus
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2), ("zero", 0.0, 1)], TARGETS)
    queue = packets(docs, targets)
    mixed = mixture(queue, budget=10**9)
    of = {r.source: r.t for r in queue.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    got = {r.source: r for r in shares(mixed, queue, targets).collect()}
    assert (got["big"].tokens, got["small"].tokens) == (of["big"], 2 * of["small"])
    assert mixture(queue, budget=0).count() == 0


def test_nothing_to_mix(spark, corpus):
    _, docs = corpus
    none = spark.createDataFrame([], TARGETS)
    assert mixture(packets(docs, none)).count() == 0
    assert mixture(packets(docs.limit(0), spark.createDataFrame([("big", 1.0, 1)], TARGETS))).count() == 0
