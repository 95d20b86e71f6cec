"""State tables as snapshots: every version in a folder of its own, a pointer file names the folders of the current one.

A snapshot is complete before the pointer moves, so readers never see half of one, and a writer that dies leaves only an
unused folder. A version may share folders with the one before: a merge rewrites the buckets that it touches and no others.
Folders that neither the current nor the previous version names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

CACHE_VERSION = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointer(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """The folders of the current version and of the one before."""
    fs, p = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(p):
        return [], []
    stream = fs.open(p)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    at = lines.index("--")
    return lines[:at], [x for x in lines[at + 1 :] if x]


def _point(spark: SparkSession, root: str, folders: list[str]) -> None:
    now, before = _pointer(spark, root)
    fs, p = _fs(spark, f"{root}/CURRENT")
    out = fs.create(p, True)
    out.write(bytearray("\n".join([*folders, "--", *now]).encode()))
    out.close()
    kept = {*folders, *now}
    for gone in before:
        if gone not in kept and not any(x.startswith(f"{gone}/") for x in kept):
            f, q = _fs(spark, f"{root}/{gone}")
            f.delete(q, True)


def read_snapshot(spark: SparkSession, root: str, schema: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The current version, or an empty table; of a version in buckets only those asked for, if any are."""
    folders, _ = _pointer(spark, root)
    if buckets is not None:
        wanted = {f"bucket={b}" for b in buckets}
        folders = [f for f in folders if "/" not in f or f.split("/")[1] in wanted]
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, root: str, *partitions: str) -> str:
    """Writes a new version and points to it; returns its name. `df` may read the current one."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{root}/{name}")
    _point(spark, root, [name])
    return name


def merge_snapshot(batch: DataFrame, root: str, schema: str, bucket: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], gather: bool = True) -> list[int]:
    """Merges a batch into the buckets that it touches: `bucket` is a small number by the key of a row, of the table and of the
    batch alike, and `merge` makes new rows of old ones and of the batch. Returns the buckets that were rewritten. Without `gather` the
    merged rows are written where they are, a file a task and bucket: for few buckets of wide rows."""
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # no more than there are buckets
    if not touched:
        return []
    held, _ = _pointer(spark, root)
    whole = [f for f in held if "/" not in f]
    old = read_snapshot(spark, root, schema, None if whole else touched)
    name = f"v-{uuid.uuid4().hex}"
    merged = merge(old, batch).withColumn("bucket", bucket)
    (merged.hint("rebalance", "bucket") if gather else merged).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/{name}")
    fs, p = _fs(spark, f"{root}/{name}")
    new = [f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")]
    rewritten = {f.split("/")[1] for f in new} | {f"bucket={b}" for b in touched}
    _point(spark, root, new + [f for f in held if not whole and f.split("/")[1] not in rewritten])
    return touched


def bootstrap(spark: SparkSession, root: str) -> None:
    """Empty state tables of a new catalog and its shards."""
    for name, schema in (("attestation", schemas.ATTESTATION), ("variant", schemas.VARIANT), ("envelope", schemas.ENVELOPE), ("contributor", schemas.CONTRIBUTOR), ("posting", schemas.POSTING)):
        write_snapshot(spark.createDataFrame([], schema), f"{root}/{name}")


def write_cache(apps: DataFrame, path: str) -> None:
    """The local cache of apps as JSON lines, each with the cache's version."""
    apps.withColumn("cache_version", F.lit(CACHE_VERSION)).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached apps; rows of another cache version or that can't be parsed are discarded."""
    df = spark.read.schema(schemas.APP_ENTRY + ", cache_version int").option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col("cache_version") == CACHE_VERSION).drop("cache_version")


def updates_from_json(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Update events that hold one delta or a list of deltas, one row each; a text that is neither raises."""
    one, many = F.from_json(column, schema, {"mode": "PERMISSIVE"}), F.from_json(column, f"array<struct<{_fields(schema)}>>")
    is_list = F.trim(F.col(column)).startswith("[")
    checked = F.when(F.trim(F.col(column)).rlike(r"^[\[{]"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("neither a delta nor a list of deltas: "), F.col(column))))
    return raw.where(checked).select(F.explode(F.when(is_list, many).otherwise(F.array(one))).alias("d")).select("d.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in schema.split(",")))


def changed_files(manifest: DataFrame, published: DataFrame) -> DataFrame:
    """(name, sha256) of files whose digest differs from the published one, or which are new."""
    return manifest.join(published, ["name", "sha256"], "left_anti")


def decoded_state(hexed: DataFrame, column: str) -> DataFrame:
    """Cached states kept as hex text; rows that aren't hex are discarded."""
    from ..functions.display import hex_decode

    return hexed.withColumn(column, hex_decode(F.col(column))).where(F.col(column).isNotNull())


def params_json(config: schemas.Config = schemas.CONFIG) -> str:
    return json.dumps({"protocol_version": config.protocol_version, "shard_count": config.shard_count, "confirmation_weight_threshold": config.confirmation_threshold, "entry_ttl_days": config.entry_ttl_days})
