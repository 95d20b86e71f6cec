"""Continuous ingestion: update events in, snapshots of state out.

Merges are commutative and idempotent, so late, repeated and reordered events need no watermark, and a micro-batch that
runs twice does no harm. Tables of facts lie in buckets by their key, and a micro-batch reads and rewrites only the buckets
that it touches. The derived catalog, whose trust depends on all entries, is recomputed once per micro-batch, or not at all
with `derive=False`, to be had when it is asked for (`finish`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.catalog import add_attestations, add_facts, add_variants, catalog_finalize, contributor_trust, delta_reason
from ..operators.postings import shard_delta_reason, shard_merge
from ..sources.snapshots import merge_snapshot, read_snapshot, write_snapshot

#: Into how many buckets the tables of facts are cut.
BUCKETS = 64


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; `files_per_trigger` bounds the rate."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _run(stream: DataFrame, merge, checkpoint: str, every: str | None) -> StreamingQuery:
    """Every so often, or over what is there if `every` is None. A restart goes on where the checkpoint ended."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def ingest_attestations(stream: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Attestations into the snapshot `root`/attestation."""

    def merge(batch: DataFrame, _: int) -> None:
        merge_snapshot(batch, f"{root}/attestation", schemas.ATTESTATION, bucket_of("contract_key"), add_attestations)

    return _run(stream, merge, checkpoint, every)


def finish(spark: SparkSession, root: str) -> None:
    """The derived snapshots of contributors and entries under `root`, from the facts there."""
    attestations, known = read_snapshot(spark, f"{root}/attestation", schemas.ATTESTATION), read_snapshot(spark, f"{root}/contributor", schemas.CONTRIBUTOR)
    write_snapshot(contributor_trust(attestations, known), f"{root}/contributor")
    write_snapshot(catalog_finalize(attestations, known), f"{root}/entry")


def ingest_deltas(stream: DataFrame, root: str, checkpoint: str, every: str | None = None, derive: bool = True) -> StreamingQuery:
    """Catalog deltas into the snapshots of attestations, variants, envelopes, contributors and entries under `root`. Rejected
    deltas go to `root`/rejected."""

    def merge(batch: DataFrame, _: int) -> None:
        marked = delta_reason(batch).persist()
        try:
            valid = marked.where("reject_reason IS NULL").drop("reject_reason")
            for name, schema, add in (("attestation", schemas.ATTESTATION, add_attestations), ("variant", schemas.VARIANT, add_variants), ("envelope", schemas.ENVELOPE, add_facts)):
                merge_snapshot(valid, f"{root}/{name}", schema, bucket_of("contract_key"), add)
            marked.where("reject_reason IS NOT NULL").write.mode("append").parquet(f"{root}/rejected")
        finally:
            marked.unpersist()
        if derive:
            finish(batch.sparkSession, root)

    return _run(stream, merge, checkpoint, every)


def ingest_postings(stream: DataFrame, root: str, checkpoint: str, every: str | None = None, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Valid shard deltas into the snapshot `root`/posting, a bucket per shard. `after` is called with the new index once a
    micro-batch is in it, to ask again what was asked before."""

    def merge(batch: DataFrame, _: int) -> None:
        valid = shard_delta_reason(batch).where("reject_reason IS NULL").select("shard_id", "word", "contract_key", "snippet", "tf_idf_score")
        merge_snapshot(valid, f"{root}/posting", schemas.POSTING, F.col("shard_id").cast("int"), shard_merge, gather=False)
        if after is not None:
            after(read_snapshot(batch.sparkSession, f"{root}/posting", schemas.POSTING))

    return _run(stream, merge, checkpoint, every)


def replay(known: DataFrame, types: DataFrame, kind: str = "WebApp") -> DataFrame:
    """The known keys without those of one type, so that their next appearance is processed again."""
    return known.join(types.where(F.col("contract_type") == kind).select("contract_key"), "contract_key", "left_anti")


def discovered(stream: DataFrame) -> DataFrame:
    """Each contract key once, at its first appearance."""
    return stream.dropDuplicates(["contract_key"])


def unknown(batch: DataFrame, known: DataFrame, queued: DataFrame) -> DataFrame:
    """Keys neither known nor queued yet."""
    return batch.select("contract_key").distinct().join(known.select("contract_key"), "contract_key", "left_anti").join(queued.select("contract_key"), "contract_key", "left_anti")


def route(responses: DataFrame, handlers: DataFrame) -> DataFrame:
    """Responses with their handler, from a small fixed table of keys; other keys are apps."""
    return responses.join(handlers, "contract_key", "left").withColumn("handler", F.coalesce("handler", F.lit("app")))
