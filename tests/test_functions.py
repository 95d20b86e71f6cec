import hashlib
import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import display, hashing, html, scoring, text
from corvane.functions.identity import public_key, sign, verified, verify
from corvane.operators.search import around, highlight
from corvane.plans import queries


def one(spark, column, **values):
    """The value of an expression over one row of typed values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def each(spark, column, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", column.alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("given_", "words"),
    [
        ("Hello, World!", ["hello", "world"]), ("the cat and THE dog", ["cat", "dog"]), ("Café Müller", ["cafe", "muller"]),
        ("a--b__c", ["b", "c"]), ("日本語 テスト", ["日本語", "テスト"]), ("", []), (" .,;", []), ("x x x", ["x", "x", "x"]),
        ("éa", ["e"]), ("İstanbul ß²", ["istanbul", "ß²"]), ("한국", [unicodedata.normalize("NFD", "한국")]), ("v2 ⅳ", ["v2", "ⅳ"]),
    ],
)
def test_words(spark, given_, words):
    df = spark.createDataFrame([(given_,)], "t string")
    assert text.with_words(df, F.col("t")).first().words == words
    assert text.tokenize_text(given_) == words


def test_words_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert text.with_words(df, F.col("t")).first().words is None


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.text(max_size=40))
def test_search_words_have_no_stop_words_and_stay(t):
    words = text.tokenize_text(t)
    assert not set(words) & set(text.STOP_WORDS)
    assert all(w for w in words)


def test_engine_and_driver_split_alike(spark):
    letters = [chr(c) for c in [*range(0x20, 0x600), *range(0x900, 0x980), *range(0x1E00, 0x2200), *range(0x3040, 0x3100), 0x4E00, 0xAC00, 0xFB01, 0xFF76, 0x1D5BA, 0x1F389]]
    texts = [f"a{c}b {c}" for c in letters if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.words for r in text.with_words(df, F.col("t")).collect()}
    differ = [texts[k] for k in got if got[k] != text.tokenize_text(texts[k])]
    # Marks that count as alphabetic (vowel signs) are letters to the engine only; newer letters may differ by Unicode version.
    assert all(any(unicodedata.category(c) in ("Mn", "Mc", "So", "Cn") for c in t) for t in differ), differ


@pytest.mark.parametrize(
    ("raw", "out"),
    [
        ("  a \t\n b  ", "a b"), ("﻿a﻿b", "ab"), ("é", "é"), ("a 　b", "a b"), ("", ""), (None, None),
        ("한", "한"), ("Å", "Å"), ("x\x1cy", "x\x1cy"), ("が", "が"),
    ],
)
def test_normalize(spark, raw, out):
    df = spark.createDataFrame([(raw, "k")], "t string, k string")
    assert text.normalized(df, "t").first().t == out
    assert df.select(text.normalize_text(F.col("t")).alias("x")).first().x == out


@settings(max_examples=25, deadline=None, derandomize=True)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_sparing_python_changes_nothing(spark, texts):
    texts = [t.replace("\0", "") for t in texts]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] or ["x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    fast = {r.k: r.t for r in text.normalized(df, "t").collect()}
    slow = {r.k: r.x for r in df.select("k", text.normalize_text(F.col("t")).alias("x")).collect()}
    assert fast == slow
    again = {r.k: r.t for r in text.normalized(text.normalized(df, "t"), "t").collect()}
    assert again == fast


def test_cuts_keep_characters_whole(spark):
    texts = ["", "abc", "äöü", "aäb", "日本語", "🎉🎉", "x🎉", "éé"]
    for n in range(1, 9):
        want = [t.encode()[:n].decode("utf-8", "ignore") for t in texts]
        assert each(spark, text.first_bytes(F.col("v"), n), texts) == want


def test_metadata_hash(spark):
    df = spark.createDataFrame([("title", "desc", "snippet"), ("ab", "c", ""), ("a", "bc", ""), ("ä", "", "日")], "a string, b string, c string")
    got = [r.h for r in df.select(hashing.metadata_hash(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()]
    assert got[0] == "6616e9dbc2db33abf4705285de8c3af068344fa5ce156a45824d36396f83a9c9"
    assert len(set(got)) == 4
    want = hashlib.sha256(b"".join(struct.pack(">Q", len(x.encode())) + x.encode() for x in ("ä", "", "日"))).hexdigest()
    assert got[3] == want


def test_shards(spark):
    words = ["hello", "test", "validate", "chat", "app", "weather"]
    assert each(spark, hashing.shard_for_word(F.col("v")), words) == [10, 1, 8, 13, 12, 11]
    assert all(0 <= s < 7 for s in each(spark, hashing.shard_for_word(F.col("v"), 7), words))


def test_proof_of_work(spark):
    assert tuple(hashing.proof_of_work(spark, 16, 1 << 16).first()) == (31429, "c57a000000000000")
    digests = ["ff" + "00" * 31, "0f" + "ff" * 31, "00" * 32, "0001" + "ff" * 30]
    assert each(spark, hashing.leading_zero_bits(F.col("v")), digests) == [0, 4, 256, 15]


def test_the_query_tries_the_whole_range_of_its_difficulty(spark, monkeypatch):
    monkeypatch.setattr(hashing, "leading_zero_bits", lambda _: F.when(F.col("id") == 4_000_000, 16).otherwise(0))
    assert queries.pow_token(spark, "").first().nonce == 4_000_000


def test_scores(spark):
    def f(*a):
        return one(spark, scoring.tf_idf(*[F.lit(x) for x in a]))

    cases = {(5, 100, 10, 2): 1500, (1, 1, 1, 1): 10_000, (1, 10, 10, 0): 0, (3, 50, 1000, 10): 4200, (1, 3, 3, 2): 3333, (1, 4, 10**6, 1): 52_500, (1, 0, 5, 1): 0}
    assert {k: f(*k) for k in cases} == cases

    def r(att, ver, subs, status):
        return one(spark, scoring.rank_score(F.lit(att), F.lit(ver), F.lit(subs), F.lit(status)))

    assert [r(100, 5, 10, s) for s in ("Confirmed", "Pending", "Disputed", "Expired")] == [5450, 2450, 450, 1450]
    assert [r(0, 0, 0, "Pending"), r(3, 1, 0, "Confirmed"), r(6, 1, 0, "Confirmed"), r(0, 0, 0, "Disputed")] == [0, 3550, 3750, 0]
    assert [one(spark, scoring.combined_score(F.lit(a), F.lit(b))) for a, b in ((10_000, 10_000), (20_000, 3550), (10_000, 0))] == [10_000, 15_065, 7000]
    assert one(spark, scoring.log_scale(F.lit(2**40))) == 41 * 500


PAGES = {
    "title": ("<html><head><title>My App</title></head></html>", "My App", None),
    "upper": ("<TITLE>Up</TITLE>", "Up", None),
    "priority": ('<h1>H</h1><meta name="application-name" content="A"><meta property="og:title" content="O"><title>T</title>', "T", None),
    "og": ('<h1>H</h1><meta name="application-name" content="A"><meta property="og:title" content="O">', "O", None),
    "application": ('<h1>H</h1><meta name="application-name" content="A">', "A", None),
    "h1": ("<h1 class='x'> Head <b>ing</b> </h1>", "Head ing", None),
    "inner": ("<title>a <b>b</b> c</title>", "a b c", None),
    "empty title": ("<title>  </title><h1>H</h1>", "H", None),
    "unclosed": ("<title>open", None, None),
    "description": ('<meta name="description" content="Short text">', None, "Short text"),
    "reversed": ('<meta content="first" name="description">', None, "first"),
    "og description": ('<meta property="og:description" content="O">', None, "O"),
    "both": ('<meta property="og:description" content="O"><meta name="description" content="D">', None, "D"),
    "single quotes": ("<meta name='description' content='no'>", None, None),
    "entities": ("<title>a &amp; b</title>", "a &amp; b", None),
    "titlebar": ("<titlebar>x</title>", "x", None),
    "nothing": ("", None, None),
    "case kept": ('<META NAME="Description" CONTENT="MiXed">', None, "MiXed"),
}


def test_titles_and_descriptions(spark):
    pages = [p for p, _, _ in PAGES.values()]
    assert dict(zip(PAGES, each(spark, html.title(F.col("v")), pages), strict=True)) == {k: t for k, (_, t, _) in PAGES.items()}
    assert dict(zip(PAGES, each(spark, html.description(F.col("v")), pages), strict=True)) == {k: d for k, (_, _, d) in PAGES.items()}


@pytest.mark.parametrize("run", ["😀a", "é", "\U0001d5ba"])
def test_long_pages_of_characters_of_any_width(spark, run):
    body = run * (1_000_000 // len(run))
    pages = [f'<p>{body}</p>', f'<p>{body}</p><meta name="description" content="D"><meta property="og:title" content="O">', f'<title>{body}</title>', f'<meta name="description" content="{body}">', f'{body}<script>{body}</script><style>{body}</style><body>{body}']
    titles = each(spark, html.title(F.col("v")), pages)
    assert [t and len(t) for t in titles] == [None, 1, len(body), None, None]
    assert [d and len(d) for d in each(spark, html.description(F.col("v")), pages)] == [None, 1, None, len(body), None]
    for column in (html.snippet, html.body_text, html.head):
        sizes = [len((t or "").encode()) for t in each(spark, column(F.col("v")), pages)]
        assert all(n > 190 for n in (sizes[0], sizes[1], sizes[2], sizes[4]))


def test_snippets(spark):
    pages = {
        "<p>Hello</p><p>World</p> 5 > 3 <!-- c > d -->": "HelloWorld 5 3 d --", "<script>x < 1</script>a<STYLE>b{}</STYLE>c": "ac",
        "<script>open a": "open a", "  a \n\n b ": "a b", "": "", "<title>T</title><body>B</body>": "TB", "a<br": "a",
    }
    assert each(spark, html.snippet(F.col("v"), 100), list(pages)) == list(pages.values())
    assert each(spark, html.snippet(F.col("v"), 5), ["<p>äöü</p>"]) == ["äö"]
    bodies = {"<head>h</head><body class=x>in<b>ner</b></body>after": "inner", "no body": "no body", "<body>open": "open", "<body> </body>": None, "<body>" + "é " * 150: "é " * 66 + "é"}
    assert each(spark, html.body_text(F.col("v")), list(bodies)) == list(bodies.values())
    assert each(spark, html.title(F.col("v"), keep_inner_tags=True), ["<title>a <b>b</b></title>"]) == ["a <b>b</b>"]


def test_display(spark):
    assert each(spark, display.size_text(F.col("v")), [0, 1023, 1024, 2047, 1_048_576, 1_600_000, None], "long") == ["0 B", "1023 B", "1 KB", "1 KB", "1.0 MB", "1.5 MB", None]
    assert each(spark, display.short_key(F.col("v")), ["short", "x" * 16, "abcdefgh" + "-" * 9 + "ijklmnop"]) == ["short", "x" * 16, "abcdefgh...ijklmnop"]
    assert each(spark, display.date_text(F.col("v")), [0, 86_400 * 365], "long") == ["—", "Jan 1 1971"]
    ago = display.relative_time(F.col("v"), F.lit(1_000_000))
    assert each(spark, ago, [1_000_000, 2_000_000, 999_941, 999_940, 996_400, 900_000], "long") == ["0s ago", "0s ago", "59s ago", "1m ago", "1h ago", "1d ago"]
    assert each(spark, display.count_text(F.col("v"), "subscriber", "subscribers"), [1, 0, 2], "long") == ["1 subscriber", "0 subscribers", "2 subscribers"]
    assert each(spark, display.hex_decode(F.col("v")), ["", "0aFF", "abc", "zz", None]) == [b"", b"\x0a\xff", None, None, None]


@pytest.mark.parametrize(("cached", "new", "want"), [(1, 1, False), (1, 2, True), (None, 2, True), (None, None, False), (1, None, False)])
def test_needs_extraction(spark, cached, new, want):
    c = lambda v: F.lit(v).cast("long")
    assert one(spark, display.needs_extraction(F.lit("t"), F.lit("d"), c(new), c(cached))) is want
    assert one(spark, display.needs_extraction(F.lit(None).cast("string"), F.lit("d"), c(new), c(cached))) is True


def test_signatures_of_the_standard():
    # Test vectors 1 to 3 of RFC 8032.
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", ""),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82"),
    ]
    for secret, key, message in ((bytes.fromhex(x) for x in v) for v in vectors):
        assert public_key(secret) == key
        signature = sign(secret, message)
        assert verify(key, message, signature)
        assert not verify(key, message + b"x", signature)
        assert not verify(key, message, signature[:-1] + bytes([signature[-1] ^ 1]))
        assert not verify(public_key(bytes(32)), message, signature)
    assert not verify(b"short", b"", bytes(64))
    assert not verify(bytes([1]) + bytes(31), b"", bytes([1]) + bytes(63))  # a point of small order


def test_signatures_in_batches(spark):
    secret = bytes(range(32))
    rows = [(public_key(secret), b"m", sign(secret, b"m")), (public_key(secret), b"n", sign(secret, b"m")), (None, b"m", sign(secret, b"m"))]
    df = spark.createDataFrame(rows, "k binary, m binary, s binary")
    assert [r.x for r in df.select(verified(F.col("k"), F.col("m"), F.col("s")).alias("x")).collect()] == [True, False, False]


def test_highlights():
    assert highlight("The Café is open", {"cafe"}) == "The <mark>Café</mark> is open"
    assert highlight("none here", {"cafe"}) == "none here"
    assert highlight("", {"x"}) == ""
    assert highlight("last word", {"word"}) == "last <mark>word</mark>"
    long = "a " * 400 + "needle " + "b " * 400
    cut = highlight(long, {"needle"})
    assert cut.startswith("...")
    assert cut.endswith("...")
    assert "<mark>needle</mark>" in cut
    assert len(cut.encode()) <= 306
    assert around("ä" * 300, 0, 300) == "ä" * 150 + "..."
    assert around("ä" * 300, 599, 301).startswith("...ä")
