import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import bloom
from corvane.sources import cbor

ITEMS = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.binary(max_size=20) | st.text(max_size=20),
    lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(max_size=5), x, max_size=5),
    max_leaves=20,
)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(ITEMS)
def test_round_trip(x):
    assert cbor.decode(cbor.encode(x)) == x


@pytest.mark.parametrize(
    ("raw", "item"),
    [("00", 0), ("1903e8", 1000), ("1bffffffffffffffff", 2**64 - 1), ("3863", -100), ("fb3ff199999999999a", 1.1), ("f4", False), ("f6", None), ("4401020304", b"\x01\x02\x03\x04"), ("62c3bc", "ü"), ("9f018202039f0405ffff", [1, [2, 3], [4, 5]]), ("bf61610161629f0203ffff", {"a": 1, "b": [2, 3]}), ("a201020304", [(1, 2), (3, 4)]), ("7f657374726561646d696e67ff", "streaming"), ("c11a514b67b0", 1363896240)],
)
def test_known_items(raw, item):
    assert cbor.decode(bytes.fromhex(raw)) == item


@pytest.mark.parametrize("raw", ["", "18", "9f01", "62c3", "fc", "0000", "1c", "a101", "81" * 80 + "00"])
def test_malformed(raw):
    with pytest.raises(cbor.Malformed):
        cbor.decode(bytes.fromhex(raw))


def key(n):
    return [n] * 32


def state():
    att = [{"contributor_pubkey": key(2), "antiflood_token": {"nonce": [1, 2], "difficulty": 16}, "token_created_at": 7, "weight": 3}]
    variant = {"title": "T", "description": "D", "mini_snippet": "S", "attestations": att, "total_weight": 3}
    entry = {"contract_key": "k", "hash_variants": cbor.Raw(cbor.pairs_blob([(key(1), variant)])), "size_bytes": 9, "version": None, "status": "Pending", "first_seen": 2**64 - 1, "last_seen": 7}
    return cbor.encode({"entries": {"k": entry}, "contributors": cbor.Raw(cbor.pairs_blob([(key(2), {"pubkey": key(2), "trust_score": 2, "total_contributions": 5})]))})


def test_catalog_states(spark):
    df = spark.createDataFrame([(state(),), (cbor.empty_blobs()["catalog"],), (None,)], "s binary")
    got = {k: [tuple(r) for r in t.collect()] for k, t in cbor.catalog_states(df, "s").items()}
    assert got == {
        "attestations": [("k", "01" * 32, "02" * 32, b"\x01\x02", 16, 7, 3)], "variants": [("k", "01" * 32, "T", "D", "S", 3)],
        "envelopes": [("k", 9, None, None, 7)], "contributors": [("02" * 32, 2, 5)],
    }
    with pytest.raises(Exception, match="Malformed"):
        cbor.shard_states(spark.createDataFrame([(b"\xff",)], "s binary"), "s").collect()


def test_shards_and_deltas(spark):
    blob = cbor.encode({"shard_id": 3, "index": {"w": [{"contract_key": "k", "snippet": "s", "tf_idf_score": 5}]}})
    assert [tuple(r) for r in cbor.shard_states(spark.createDataFrame([(blob,), (cbor.empty_blobs()["shard-0"],)], "s binary"), "s").collect()] == [(3, "w", "k", "s", 5)]
    rows = [("k", "t", "d", "m", "s", 1, None, "ab" * 32, "cd" * 32, b"12", 16, 5), ("j", "t", "d", "m", "s", 1, 4, "ab" * 32, "cd" * 32, b"12", 16, 5)]
    deltas = spark.createDataFrame(rows, schemas.CATALOG_DELTA)
    blobs = cbor.delta_blobs(deltas)
    assert sorted(tuple(r) for r in cbor.catalog_deltas(blobs, "delta").select(deltas.columns).collect()) == sorted(rows)
    both = cbor.encode([cbor.Raw(r.delta) for r in blobs.collect()])
    assert cbor.catalog_deltas(spark.createDataFrame([(both,), (b"",), (None,)], "s binary"), "s").count() == 2
    postings = spark.createDataFrame([(k % 2, f"w{k}", "k", "s", k) for k in range(50)], schemas.POSTING)
    sent = cbor.shard_delta_blobs(postings, batch=10)
    assert sent.count() > 4
    back = cbor.shard_deltas(sent, "delta")
    assert sorted(r.word for r in back.collect()) == sorted(f"w{k}" for k in range(50))
    assert {(bytes(r.nonce), r.difficulty) for r in back.collect()} == {(bytes(8), 1)}


def test_filters(spark):
    bits = bloom.bloom_bits(spark.createDataFrame([(b"hello",), (b"world",)], "i binary"), F.col("i"))
    blob = bloom.packed(bits).select(cbor.filter_blob(F.col("bytes")).alias("f"))
    assert {r.bit for r in cbor.filter_bits(blob, "f").collect()} == {r.bit for r in bits.collect()}


def test_states_are_written_and_read(spark):
    key = lambda n: f"{n:064x}"
    envelope = spark.createDataFrame([("a", 5, 2, 1, 9), ("b", None, None, None, 3), (None, 1, 1, 1, 1)], "contract_key string, size_bytes long, version long, first_seen long, last_seen long")
    variants = spark.createDataFrame([("a", key(1), "T", "D", "m"), ("a", key(2), None, "", "m2")], "contract_key string, metadata_hash string, title string, description string, mini_snippet string")
    atts = spark.createDataFrame([("a", key(1), key(7), b"n", 16, 5, 2), ("a", key(1), key(8), None, None, 6, 3)], "contract_key string, metadata_hash string, contributor_pubkey string, nonce binary, difficulty short, token_created_at long, weight long")
    people = spark.createDataFrame([(key(7), 4, 9)], "pubkey string, trust_score long, total_contributions long")
    read = cbor.catalog_states(cbor.catalog_blobs(variants, atts, envelope, people), "state")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(read["envelopes"]) == [("a", 5, 2, 1, 9), ("b", None, None, None, 3)]
    assert rows(read["variants"]) == [("a", key(1), "T", "D", "m", 5), ("a", key(2), "", "", "m2", 0)]
    assert rows(read["attestations"].drop("nonce")) == [("a", key(1), key(7), 16, 5, 2), ("a", key(1), key(8), 0, 6, 3)]
    assert rows(read["contributors"]) == [(key(7), 4, 9)]
    postings = spark.createDataFrame([(3, f"w{k % 4}", f"k{k}", "s", k) for k in range(30)], "shard_id short, word string, contract_key string, snippet string, tf_idf_score long")
    blobs = cbor.shard_blobs(postings, batch=7)
    assert blobs.count() > 1
    assert rows(cbor.shard_states(blobs, "state")) == rows(postings)
