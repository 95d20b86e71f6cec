import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators.catalog import attestation_union, catalog_finalize
from corvane.operators.postings import shard_merge
from corvane.session import shared_folder
from corvane.sources.snapshots import merge_snapshot, read_snapshot, write_snapshot
from corvane.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_attestations_in_batches_equal_one_batch(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    facts = [("k" + str(i % 4), f"h{i % 2}", f"p{i % 7}", bytes([i % 3]), 1, 100 - i) for i in range(40)]
    for part in range(4):
        write(spark, facts[part::4] + facts[:2], schemas.ATTESTATION, src)
    ingest.ingest_attestations(ingest.read_events(spark, src, schemas.ATTESTATION, 1), root, f"{root}/log").awaitTermination()
    want = rows(attestation_union(spark.createDataFrame(facts, schemas.ATTESTATION)))
    assert rows(read_snapshot(spark, f"{root}/attestation", schemas.ATTESTATION)) == want
    # A restart reads only what is new, late and repeated events change nothing.
    late = [("late", "h0", "p0", b"1", 1, 1), facts[3]]
    write(spark, late, schemas.ATTESTATION, src)
    ingest.ingest_attestations(ingest.read_events(spark, src, schemas.ATTESTATION), root, f"{root}/log").awaitTermination()
    assert rows(read_snapshot(spark, f"{root}/attestation", schemas.ATTESTATION)) == sorted([*want, late[0]], key=repr)


def test_deltas_end_in_a_finished_catalog(spark, tmp_path):
    def h(*texts):
        return hashlib.sha256(b"".join(struct.pack(">Q", len(t)) + t.encode() for t in texts)).hexdigest()

    def delta(key, who, good=True):
        return (key, "t", "d", "m", "s", 10, 1, h("t", "d", "s") if good else "00", f"{who:064x}", b"1", 1, 5)

    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, [delta("a", 1), delta("a", 2), delta("b", 1), delta("b", 4, good=False)], schemas.CATALOG_DELTA, src)
    write(spark, [delta("a", 3), delta("a", 3)], schemas.CATALOG_DELTA, src)
    ingest.ingest_deltas(ingest.read_events(spark, src, schemas.CATALOG_DELTA, 1), root, f"{root}/log").awaitTermination()
    entry = "contract_key string, status string, att_count long, weighted_att long, best_hash string, best_weight long"
    got = {r.contract_key: (r.status, r.att_count, r.weighted_att) for r in read_snapshot(spark, f"{root}/entry", entry).collect()}
    assert got == {"a": ("Confirmed", 3, 6), "b": ("Pending", 1, 2)}
    facts = read_snapshot(spark, f"{root}/attestation", schemas.ATTESTATION)
    assert rows(catalog_finalize(facts, read_snapshot(spark, f"{root}/contributor", schemas.CONTRIBUTOR)).select("contract_key", "status")) == [("a", "Confirmed"), ("b", "Pending")]
    assert [r.reject_reason for r in spark.read.parquet(f"{root}/rejected").collect()] == ["wrong hash"]


def test_postings_keep_the_highest_score(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    good = [(11, "weather", "k1", "s", 3000, b"1", 1), (11, "weather", "k1", "better", 5000, b"1", 1), (11, "weather", "k2", "s", 1, b"1", 1)]
    for d in [*good, (2, "weather", "k3", "s", 9, b"1", 1), (11, "weather", "k4", "s", 9, b"", 1)]:
        write(spark, [d], schemas.SHARD_DELTA, src)
    ingest.ingest_postings(ingest.read_events(spark, src, schemas.SHARD_DELTA, 2), root, f"{root}/log").awaitTermination()
    got = read_snapshot(spark, f"{root}/posting", schemas.POSTING)
    assert rows(got.select("word", "contract_key", "snippet", "tf_idf_score")) == [("weather", "k1", "better", 5000), ("weather", "k2", "s", 1)]
    assert rows(shard_merge(got).select("tf_idf_score")) == [(1,), (5000,)]
    assert (tmp_path / "state" / "posting").exists()


def test_keys_are_discovered_once(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, [("a",), ("b",), ("a",)], "contract_key string", src)
    write(spark, [("b",), ("c",)], "contract_key string", src)
    q = ingest.discovered(ingest.read_events(spark, src, "contract_key string", 1)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("found")) == [("a",), ("b",), ("c",)]
    known, queued = (spark.createDataFrame([(x,)], "contract_key string") for x in "ab")
    assert rows(ingest.unknown(spark.table("found"), known, queued)) == [("c",)]
    handlers = spark.createDataFrame([("a", "catalog")], "contract_key string, handler string")
    assert {r.contract_key: r.handler for r in ingest.route(spark.table("found"), handlers).collect()} == {"a": "catalog", "b": "app", "c": "app"}


def test_stream_over_a_given_table(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    streamed = e.queries()["stream_attestations"](spark, d)
    assert rows(streamed) == rows(e.queries()["attestation_union"](spark, d).select(streamed.columns))
    assert streamed.where(F.col("contract_key").isNull()).count() == 0


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "k long, v long"
    table = lambda *data: spark.createDataFrame(data, schema)
    largest = lambda old, new: old.unionByName(new.select("k", "v")).groupBy("k").agg(F.max("v").alias("v"))
    bucket = F.col("k").cast("int") % 8
    assert merge_snapshot(table(*((k, 1) for k in range(16))), root, schema, bucket, largest) == list(range(8))
    before = (tmp_path / "t" / "CURRENT").read_text().split("\n--")[0].split("\n")
    assert merge_snapshot(table((3, 5), (11, 0), (19, 2)), root, schema, bucket, largest) == [3]
    after = (tmp_path / "t" / "CURRENT").read_text().split("\n--")[0].split("\n")
    assert {*before} - {*after} == {f for f in before if f.endswith("bucket=3")}
    assert rows(read_snapshot(spark, root, schema)) == sorted([(k, 5 if k == 3 else 1) for k in range(16)] + [(19, 2)], key=repr)
    assert rows(read_snapshot(spark, root, schema, buckets=[3])) == [(11, 1), (19, 2), (3, 5)]
    assert merge_snapshot(table(), root, schema, bucket, largest) == []
    # Replaced folders go once two newer versions exist; a table written as a whole is cut into buckets by the first merge.
    merge_snapshot(table((3, 6)), root, schema, bucket, largest)
    assert not list((tmp_path / "t").glob(before[3].split("/")[0] + "/bucket=3"))
    write_snapshot(table((1, 1), (2, 2)), root)
    assert merge_snapshot(table((2, 7)), root, schema, bucket, largest) == [2]
    assert rows(read_snapshot(spark, root, schema)) == [(1, 1), (2, 7)]


def test_a_search_is_asked_again_after_each_batch(spark, tmp_path):
    src, root, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    for n in range(3):
        write(spark, [(11, "weather", f"k{n}", "s", n, b"1", 1)], schemas.SHARD_DELTA, src)
    ingest.ingest_postings(ingest.read_events(spark, src, schemas.SHARD_DELTA, 1), root, f"{root}/log", after=lambda index: seen.append(index.count())).awaitTermination()
    assert seen == [1, 2, 3]


def test_replayed_keys_are_unknown_again(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "contract_key string")
    types = spark.createDataFrame([("a", "WebApp"), ("b", "Data")], "contract_key string, contract_type string")
    assert rows(ingest.replay(known, types)) == [("b",), ("c",)]


def test_intermediate_tables_need_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x"}
    assert shared_folder(Session) == "hdfs://x"
