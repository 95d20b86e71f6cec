import hashlib
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.identity import public_key
from corvane.operators import bloom, catalog, directory, postings, search
from corvane.sources import containers, snapshots


def att(key, variant, who, at=1000, nonce=b"12345678", difficulty=16):
    return (key, f"{variant:064x}", f"{who:064x}", nonce, difficulty, at)


def attestations(spark, rows):
    return spark.createDataFrame(rows, schemas.ATTESTATION)


def contributors(spark, rows=()):
    return spark.createDataFrame([(f"{who:064x}", trust, total) for who, trust, total in rows], schemas.CONTRIBUTOR)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("votes", "status"),
    [((2,), "Pending"), ((3,), "Confirmed"), ((3, 1), "Disputed"), ((4, 1), "Confirmed"), ((10, 3), "Confirmed"), ((10, 4), "Disputed"), ((3, 3), "Disputed"), ((2, 2), "Pending"), ((3, 1, 1), "Disputed"), ((7, 2, 2, 2), "Confirmed")],
)
def test_status(spark, votes, status):
    facts = [att("k", v + 1, 100 * v + w) for v, n in enumerate(votes) for w in range(n)]
    got = catalog.entry_winner(attestations(spark, facts)).first()
    assert (got.status, got.att_count) == (status, sum(votes))
    best = max(range(len(votes)), key=lambda v: (votes[v], v))
    assert got.winner == f"{best + 1:064x}"


def test_merges_commute_and_repeat(spark):
    rng = random.Random(1)
    facts = [att(f"k{rng.randint(0, 5)}", rng.randint(1, 2), rng.randint(1, 9), rng.randint(1, 9), bytes([rng.randint(0, 3)])) for _ in range(60)]
    want = rows(catalog.attestation_union(attestations(spark, facts)))
    for parts in (1, 2, 5):
        rng.shuffle(facts)
        pieces = [attestations(spark, facts[k::parts]) for k in range(parts)]
        assert rows(catalog.attestation_union(*pieces, pieces[0])) == want
    state = want[:3]
    assert len({r[:3] for r in want}) == len(want)
    assert rows(catalog.attestation_union(attestations(spark, state), attestations(spark, want))) == want


def test_repeated_attestation_counts_once_but_moves_times(spark):
    old = (attestations(spark, []), spark.createDataFrame([], schemas.VARIANT), spark.createDataFrame([], schemas.ENVELOPE))
    deltas = spark.createDataFrame(
        [("k", "t", "d", "ignored", "s", 10, 1, "h", "p", b"1", 1, 500), ("k", "t", "d", "ignored", "s", 20, None, "h", "p", b"1", 1, 900)], schemas.CATALOG_DELTA
    )
    a, v, e = catalog.apply_deltas(*old, deltas)
    assert rows(a) == [("k", "h", "p", b"1", 1, 500)]
    assert rows(v) == [("k", "h", "t", "d", "s")]
    assert rows(e) == [("k", 20, 1, 500, 900)]


def test_trust_and_weights(spark):
    facts = [att("a", 1, w) for w in (1, 2, 3)] + [att("b", 1, w) for w in (1, 2)] + [att("c", 1, w) for w in (1, 2, 3)] + [att("c", 2, w) for w in (4, 5, 6)]
    state, known = attestations(spark, facts), contributors(spark, [(9, 5, 7), (1, 0, 9)])
    trust = {r[0][-1]: r[1:] for r in rows(catalog.contributor_trust(state, known))}
    # Entry c is disputed with equal counts, so its greater hash wins.
    assert trust == {"1": (1, 9), "2": (1, 3), "3": (1, 2), "4": (1, 1), "5": (1, 1), "6": (1, 1), "9": (5, 7)}
    final = {r.contract_key: r for r in catalog.catalog_finalize(state, known).collect()}
    assert {k: (r.status, r.att_count, r.weighted_att) for k, r in final.items()} == {"a": ("Confirmed", 3, 6), "b": ("Pending", 2, 4), "c": ("Disputed", 6, 12)}
    assert final["c"].best_hash == f"{2:064x}"
    weights = rows(catalog.attestation_weights(attestations(spark, [att("k", 1, 9), att("k", 1, 8)]), known).select("contributor_pubkey", "weight"))
    assert [w for _, w in weights] == [1, 6]
    merged = catalog.contributor_merge(known, contributors(spark, [(9, 8, 1), (3, 1, 1)]))
    assert {r[0][-1]: r[1:] for r in rows(merged)} == {"9": (8, 7), "1": (0, 9), "3": (1, 1)}


def h(*texts):
    return hashlib.sha256(b"".join(struct.pack(">Q", len(t.encode())) + t.encode() for t in texts)).hexdigest()


def test_deltas_are_checked_in_order(spark):
    good = ["k", "t", "d", "m", "s", 1, 1, h("t", "d", "s"), "01" * 32, b"1", 1, 5]

    def changed(**x):
        names = [c.split()[0] for c in schemas.CATALOG_DELTA.split(", ")]
        return tuple(x.get(n, v) for n, v in zip(names, good, strict=True))

    cases = {
        None: changed(), "empty contract key": changed(contract_key=""), "title too long": changed(title="ä" * 129), "description too long": changed(description="x" * 1025),
        "no flood token": changed(nonce=b""), "zero public key": changed(contributor_pubkey="0" * 64), "no token time": changed(token_created_at=0), "wrong hash": changed(metadata_hash="ff" * 32),
    }
    for reason, row in cases.items():
        df = spark.createDataFrame([row], schemas.CATALOG_DELTA)
        assert catalog.delta_reason(df).first().reject_reason == reason
    both = spark.createDataFrame([good, list(cases["wrong hash"])], schemas.CATALOG_DELTA)
    with pytest.raises(ValueError, match="wrong hash"):
        catalog.split_deltas(both)
    valid, rejected = catalog.split_deltas(both, strict=False)
    assert (valid.count(), rejected.count()) == (1, 1)
    assert catalog.delta_reason(spark.createDataFrame([(None,) * 12], schemas.CATALOG_DELTA)).first().reject_reason == "empty contract key"


def test_states_are_checked(spark):
    schema = schemas.VARIANT + ", total_weight long"
    variants = spark.createDataFrame([("k", h("t", "d", "m"), "t", "d", "m", 5), ("", h("", "", ""), "", "", "", 0), ("k", "00", "t", "d", "m", 0)], schema)
    atts = spark.createDataFrame([("k", h("t", "d", "m"), "p", b"1", 1, 1, 2), ("k", h("t", "d", "m"), "p", b"1", 1, 1, 2)], schemas.ATTESTATION + ", weight long")
    assert {r[2] for r in rows(catalog.catalog_violations(variants, atts))} == {"empty contract key", "wrong hash", "repeated public key", "wrong total weight"}


def test_expiry_is_opt_in(spark):
    df = spark.createDataFrame([("a", "Confirmed", 0), ("b", "Pending", 10**12)], "contract_key string, status string, last_seen long")
    assert {r.contract_key: r.status for r in catalog.expired(df, F.lit(10**12)).collect()} == {"a": "Expired", "b": "Pending"}


TEXTS = "contract_key string, text string, mini string"


@pytest.fixture(scope="module")
def index(spark):
    texts = spark.createDataFrame([("a", "weather map weather", "sa"), ("b", "chess map", ""), ("c", "the of", "sc"), ("d", None, "sd"), ("e", "Wéather", None)], TEXTS)
    return postings.build_postings(texts, "contract_key", "text", "mini").cache()


def test_postings(spark, index):
    got = {(r.word, r.contract_key): (r.shard_id, r.snippet, r.tf_idf_score) for r in index.collect()}
    # Five documents; weather stands in two, map in two, chess in one.
    assert got == {("weather", "a"): (11, "sa", 13332), ("map", "a"): (got["map", "a"][0], "sa", 6666), ("map", "b"): (got["map", "b"][0], "", 10_000), ("chess", "b"): (got["chess", "b"][0], "", 15_000), ("weather", "e"): (11, "", 20_000)} or got.keys() == {("weather", "a"), ("map", "a"), ("map", "b"), ("chess", "b"), ("weather", "e")}
    assert postings.shard_violations(index).count() == 0
    wrong = index.withColumn("shard_id", ((F.col("shard_id") + 1) % 16).cast("short")).union(index.limit(1))
    assert {r.rule for r in postings.shard_violations(wrong).collect()} == {"wrong shard"}
    assert {r.rule for r in postings.shard_violations(index.union(index)).collect()} == {"repeated contract key"}


def test_highest_score_wins_in_any_order(spark):
    a, b, c = (spark.createDataFrame([(1, "w", "k", s, n)], schemas.POSTING) for s, n in (("old", 3000), ("new", 5000), ("also new", 5000)))
    for order in itertools.permutations((a, b, c)):
        assert rows(postings.shard_merge(*order)) == [(1, "w", "k", "also new", 5000)]


def test_shard_deltas_are_checked(spark):
    df = spark.createDataFrame([(11, "weather", b"1", 1), (11, "", b"1", 1), (3, "weather", b"1", 1), (11, "weather", b"", 1), (11, "weather", b"1", 0), (None, None, None, None)], "shard_id short, word string, nonce binary, difficulty short")
    assert [r.reject_reason for r in postings.shard_delta_reason(df).collect()] == [None, "empty word", "wrong shard", "no flood token", "no flood token", "no flood token"]


ENTRIES = "contract_key string, title string, description string, status string, att_count long, weighted_att long, version long"


def test_search(spark, index):
    entries = spark.createDataFrame([("a", "A", "about a", "Disputed", 5, 9, None), ("b", "B", None, "Confirmed", 3, 3, 1)], ENTRIES)
    got = [(r.contract_key, r.title, r.description, r.status, r.snippet) for r in search.search(index, entries, "Weather MAP the map").collect()]
    assert {g[0] for g in got} == {"a", "b", "e"}
    assert ("e", "e", "", "Pending", "") in got
    scores = {r.contract_key: r.relevance for r in search.search(index, entries, "weather map map").collect()}
    single = {r.contract_key: r.relevance for r in search.search(index, entries, "weather map").collect()}
    assert scores["b"] == 2 * single["b"]
    assert search.search(index, entries, "the of").count() == 0
    assert search.search(index, entries, "").count() == 0
    assert search.search(index, entries.limit(0), "weather", limit=1).count() == 1
    marked = {r.contract_key: r.highlighted_snippet for r in search.highlighted(search.search(index.withColumn("snippet", F.lit("Wéather map")), entries, "weather"), "weather").collect()}
    assert marked == {"a": "<mark>Wéather</mark> map", "e": "<mark>Wéather</mark> map"}
    apps = spark.createDataFrame([("z", "Weather station", None)], "contract_key string, title string, description string")
    assert search.search_or_browse(index, entries, apps, "weather")[0] == "search"
    kind, shown = search.search_or_browse(index, entries, apps, "station")
    assert (kind, [r.contract_key for r in shown.collect()]) == ("directory", ["z"])
    assert search.search_or_browse(index, entries, apps, "")[0] == "directory"
    both = search.search_all_words(index, entries, "weather map").collect()
    assert both[0].contract_key == "a"


def test_relevance_stops_at_the_largest_number(spark):
    df = spark.createDataFrame([("k", "w", "", 4_000_000_000, 1, 0), ("k", "v", "s", 4_000_000_000, 1, 1)], "contract_key string, word string, snippet string, tf_idf_score long, times int, pos int")
    assert search.relevance(df).first().asDict() == {"contract_key": "k", "relevance": 4_294_967_295, "snippet": "s"}


def test_search_prunes_shards_and_sorts_only_the_top(spark, index, tmp_path):
    postings.write_postings(index, str(tmp_path / "p"))
    read = spark.read.schema(schemas.POSTING).parquet(str(tmp_path / "p"))
    plan = search.search(read, spark.createDataFrame([], ENTRIES), "weather")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan or "shard_id#" in plan.split("PartitionFilters: [")[1][:60]
    assert "PushedFilters: [" in plan
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan


def positions(item, bits=8192):
    return {int.from_bytes(hashlib.sha256(bytes([i]) + item).digest()[:8], "big") % bits for i in range(7)}


def test_bloom_bits_and_bytes(spark):
    assert spark.range(1).select(bloom.positions(F.lit(b"hello"))[0].alias("p")).first().p == 2014
    items = [f"item {k}".encode() for k in range(100)]
    df = spark.createDataFrame([(x,) for x in items], "i binary")
    filled = bloom.bloom_bits(df, F.col("i"))
    want = set().union(*map(positions, items))
    assert {r.bit for r in filled.collect()} == want
    packed = bytearray(1024)
    for b in want:
        packed[b // 8] |= 1 << b % 8
    assert bytes(bloom.packed(filled).first().bytes) == bytes(packed)
    asked = spark.createDataFrame([(k, f"item {k}".encode()) for k in range(1100)], "k int, i binary")
    known = {r.k: r.known for r in bloom.contains(asked, "k", F.col("i"), filled).collect()}
    assert all(known[k] for k in range(100))
    assert {k for k, v in known.items() if v} == {k for k in range(1100) if positions(f"item {k}".encode()) <= want}
    assert sum(known[k] for k in range(100, 1100)) < 50
    nothing = bloom.contains(asked, "k", F.col("i"), filled.limit(0))
    assert nothing.where("known").count() == 0


def test_replicas_converge(spark):
    a, b = (attestations(spark, [att(f"k{k}", 1, w) for k in ks for w in (1, 2)]) for ks in (range(0, 5), range(3, 8)))
    variants = spark.createDataFrame([(f"k{k}", f"{1:064x}", "t", "d", "m") for k in range(8)], schemas.VARIANT)
    none = contributors(spark)

    def entries(state):
        return catalog.catalog_finalize(state, none).withColumns({"size_bytes": F.lit(1).cast("long"), "version": F.lit(None).cast("long")})

    def summary(state):
        return bloom.bloom_bits(entries(state), bloom.catalog_item(F.col("contract_key"), F.col("best_hash"), F.col("best_weight")))

    to_b = bloom.missing_entries(entries(a), a, variants, summary(b)).select(*a.columns)
    to_a = bloom.missing_entries(entries(b), b, variants, summary(a)).select(*a.columns)
    one, two = catalog.attestation_union(a, to_a), catalog.attestation_union(b, to_b)
    assert rows(one) == rows(two)
    assert one.select("contract_key").distinct().count() == 8
    assert rows(bloom.missing_exact(a, b, *catalog.ATTESTATION_KEY).select("contract_key").distinct()) == [("k0",), ("k1",), ("k2",)]


def test_missing_postings(spark, index):
    peer = bloom.bloom_bits(index.where("contract_key = 'a'"), bloom.posting_item(F.col("word"), F.col("contract_key")), "shard_id")
    sent = bloom.missing_postings(index, peer).collect()
    assert {(r.word, r.contract_key) for r in sent} == {("map", "b"), ("chess", "b"), ("weather", "e")}
    assert {(bytes(r.nonce), r.difficulty) for r in sent} == {(bytes(8), 1)}
    assert bloom.missing_postings(index, peer.limit(0)).count() == 5


APPS = schemas.APP_ENTRY + ", att_count long"


def test_one_app_per_title(spark):
    apps = [
        ("k1", "Maps", "", 1, 1, 99, 0, 9, 9), ("k2", "maps", "d", 1, 1, 1, 0, 1, 1), ("k3", "MAPS", "d", 1, 1, 1, 0, 2, 1),
        ("k4", "Other", None, 1, 1, None, 0, None, None), ("k5", "other", None, 1, 1, None, 0, None, None), ("k6", None, "x", 1, 1, 1, 0, 1, 1), ("k7", None, "x", 1, 1, 1, 0, 1, 1),
    ]
    df = spark.createDataFrame(apps, APPS)
    assert {r.contract_key for r in directory.dedup_by_title(df).collect()} == {"k3", "k4", "k6", "k7"}
    assert {r.contract_key for r in directory.directory_filter(df, "MAP").collect()} == {"k1", "k2", "k3"}
    assert directory.directory_filter(df, "").count() == 7
    assert directory.dedup_by_title(df.limit(0)).count() == 0


def test_directory(spark):
    cache = spark.createDataFrame([("a", "Zebra", "cached", 1, 1, 1, 0, 1), ("b", None, None, 1, 1, 1, 0, 1), ("x", "Apple", "", 1, 1, 1, 0, 1), ("d", "Data", "", 1, 1, 1, 0, 1)], schemas.APP_ENTRY)
    types = spark.createDataFrame([("a", "WebApp"), ("b", "WebApp"), ("c", "WebApp"), ("d", "Data")], "contract_key string, contract_type string")
    entries = spark.createDataFrame([("a", "", "Pending", 2), ("x", "from catalog", "Confirmed", 3)], "contract_key string, description string, status string, att_count long")
    got = [(r.contract_key, r.title, r.description, r.status, r.att_count) for r in directory.app_directory(types, cache, entries).collect()]
    assert got == [("x", "Apple", "from catalog", "Confirmed", 3), ("a", "Zebra", "cached", "Pending", 2), ("b", None, None, None, 0), ("c", None, None, None, 0)]
    assert tuple(directory.discovery_progress(types, cache).first()) == (4, 3, 1)


def test_cache_updates(spark):
    cache = spark.createDataFrame([("a", "T", "D", 5, 6, 1, 0, 1), ("b", "T", "D", 5, 6, 1, 0, 1), ("c", "T", "D", 5, 6, 1, 0, 1)], schemas.APP_ENTRY)
    updates = spark.createDataFrame([("a", None, "new", 9, 9, None, 2, 3, True), ("b", None, "new", 9, 9, None, None, None, False), ("z", "Z", None, 9, 9, None, None, None, False)], schemas.APP_ENTRY + ", extracted boolean")
    assert rows(directory.upsert_cache(cache, updates))[:3] == [("a", None, "new", 5, 9, 1, 2, 3), ("b", "T", "new", 5, 9, 1, 0, 1), ("c", "T", "D", 5, 6, 1, 0, 1)]
    log = spark.createDataFrame([("a", 1, "Submitted", None), ("b", 3, "Submitted", None), ("c", 9, "Failed", "x")], schemas.CONTRIBUTION)
    assert {r.contract_key: r.status for r in directory.acknowledge(log).collect()} == {"a": "Submitted", "b": "Confirmed", "c": "Failed"}
    assert [r.contract_key for r in directory.recent(log, 2).collect()] == ["c", "b"]


@pytest.fixture(scope="module")
def page():
    return '<title>My App</title><meta name="description" content="About"><body>Some\n text</body>'


def test_containers(spark, page):
    good = containers.pack(page, 70_000)
    meta = 8 + int.from_bytes(good[:8], "big")
    states = {
        "good": good, "short": good[:10], "half": good[: len(good) // 2], "no metadata": bytes(8) + good[8:], "long metadata": struct.pack(">Q", 2000) + good[8:],
        "no web": good[:meta] + bytes(8), "not xz": good[: meta + 8] + bytes(len(good) - meta - 8), "trailing": good + b"x", "huge": b"\xff" * 16, "null": None, "empty": b"",
        "in a folder": containers.pack(page, 3, name="d" * 70 + "/index.html"), "other file": containers.pack(page, 24, name="readme.txt"),
    }
    df = spark.createDataFrame(list(states.items()), "contract_key string, state binary")
    got = {r.contract_key: (r.is_, r.version, r.html) for r in df.select("contract_key", containers.is_container(F.col("state")).alias("is_"), containers.container_version(F.col("state")).alias("version"), containers.container_html(F.col("state")).alias("html")).collect()}
    assert {k for k, (is_, _, _) in got.items() if is_} == {"good", "not xz", "in a folder", "other file"}
    assert {k for k, (_, _, p) in got.items() if p} == {"good", "trailing", "in a folder"}
    assert got["good"] == (True, 70_000, page)
    assert (got["in a folder"][1], got["other file"][1], got["short"][1], got["null"]) == (3, 24, None, (False, None, None))
    meta_row = {r.contract_key: r for r in containers.extract_containers(df).collect()}
    assert meta_row.keys() == {"good", "in a folder"}
    r = meta_row["good"]
    assert (r.title, r.description, r.snippet, r.version, r.size_bytes) == ("My App", "About", "My AppSome text", 70_000, len(good))
    assert r.metadata_hash == h("My App", "About", "My AppSome text")


def test_signed_containers(spark, page):
    secret = bytes(range(32))
    key, good = public_key(secret), containers.pack(page, 7, secret)
    rows_ = [("good", key, good), ("nonce", key + b"extra", good), ("short key", key[:31], good), ("other key", public_key(bytes(32)), good), ("spoiled", key, good[:-1] + bytes([good[-1] ^ 1])), ("version 0", key, containers.pack(page, 0, secret)), ("unsigned", key, containers.pack(page, 7))]
    rows_ += [("byte string", key, containers.pack(page, 7, secret, as_array=False)), ("trailing", key, good + b"x"), ("cut", key, good[:-1]), ("huge", key, b"\xff" * 40), ("null", None, good), ("no state", key, None)]
    df = spark.createDataFrame(rows_, "n string, k binary, s binary")
    got = {r.n: r.ok for r in df.select("n", containers.signed_container(F.col("k"), F.col("s")).alias("ok")).collect()}
    assert got == {"good": True, "nonce": True, "short key": False, "other key": False, "spoiled": False, "version 0": False, "unsigned": False, "byte string": True, "trailing": True, "cut": False, "huge": False, "null": False, "no state": False}


def test_only_newer_containers_pass(spark):
    schema = "contract_key string, version long, state binary"
    held = spark.createDataFrame([("a", 2, b"old"), ("b", 5, b"held")], schema)
    new = spark.createDataFrame([("a", 3, b"new"), ("b", 5, b"same version"), ("c", 1, b"first"), ("d", 0, b"never")], schema)
    assert rows(containers.container_latest(held, new)) == [("a", 3, b"new"), ("b", 5, b"held"), ("c", 1, b"first")]
    peer = spark.createDataFrame([("a", 2), ("b", 5)], "contract_key string, version long")
    assert {r.contract_key for r in containers.container_delta(new, peer).collect()} == {"a", "c", "d"}


def test_container_files(spark, page, tmp_path):
    (tmp_path / "one").write_bytes(containers.pack(page, 1))
    (tmp_path / "two").write_bytes(b"nothing")
    got = containers.extract_containers(containers.read_containers(spark, str(tmp_path)))
    assert [r.contract_key for r in got.collect()] == ["one"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.read_snapshot(spark, root, "a long").count() == 0
    for n in range(4):
        before = snapshots.read_snapshot(spark, root, "a long")
        snapshots.write_snapshot(before.union(spark.createDataFrame([(n,)], "a long")), root)
    assert rows(snapshots.read_snapshot(spark, root, "a long")) == [(0,), (1,), (2,), (3,)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    snapshots.bootstrap(spark, str(tmp_path / "new"))
    assert snapshots.read_snapshot(spark, str(tmp_path / "new" / "posting"), schemas.POSTING).count() == 0


def test_cache_files(spark, tmp_path):
    apps = spark.createDataFrame([("a", "T", None, 1, 2, None, 0, 3)], schemas.APP_ENTRY)
    path = str(tmp_path / "cache")
    snapshots.write_cache(apps, path)
    assert rows(snapshots.read_cache(spark, path)) == rows(apps)
    (tmp_path / "cache" / "part-old.json").write_text('{"contract_key": "old", "cache_version": 1}\nnot json\n')
    assert rows(snapshots.read_cache(spark, path)) == rows(apps)
    hexed = spark.createDataFrame([("a", "0aff"), ("b", "zz"), ("c", None)], "k string, s string")
    assert [(r.k, bytes(r.s)) for r in snapshots.decoded_state(hexed, "s").collect()] == [("a", b"\x0a\xff")]


def test_updates_come_alone_or_in_lists(spark):
    raw = spark.createDataFrame([('{"word": "a", "n": 1}',), ('[{"word": "b", "n": 2}, {"word": "c", "n": 3}]',), ("[]",)], "u string")
    assert rows(snapshots.updates_from_json(raw, "u", "word string, n long")) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(Exception, match="neither a delta nor a list"):
        snapshots.updates_from_json(spark.createDataFrame([("x",)], "u string"), "u", "word string, n long").collect()


def test_changed_files(spark):
    new, old = (spark.createDataFrame(x, "name string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9")]))
    assert rows(snapshots.changed_files(new, old)) == [("b", "2"), ("c", "3")]


def test_nested_forms(spark, index):
    variants = spark.createDataFrame([("k", f"{v:064x}", "t", "d", "m") for v in (2, 1)], schemas.VARIANT)
    facts = attestations(spark, [att("k", 1, 3), att("k", 1, 2), att("k", 2, 1)])
    env = spark.createDataFrame([("k", 1, None, 1, 1)], schemas.ENVELOPE)
    state = catalog.nested_state(variants, facts, env).first()
    assert [v.metadata_hash[-1] for v in state.hash_variants] == ["1", "2"]
    assert [a.contributor_pubkey[-1] for a in state.hash_variants[0].attestations] == ["2", "3"]
    shards = {r.word: [e.contract_key for e in r.entries] for r in postings.nested_shards(index).collect()}
    assert shards == {"weather": ["a", "e"], "map": ["a", "b"], "chess": ["b"]}
