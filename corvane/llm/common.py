"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per `key`: the one with the greatest `order` columns, nulls lowest. Rows equal in all of `order` are told
    apart by the remaining columns, so the result does not depend on the order of arrival. Rows without a key are kept out."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = F.max(F.struct(*[F.col(c) for c in (*order, *rest)])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_best.*").select(*df.columns)


def text_of(*cols: str) -> Column:
    """The texts of several columns with a blank between them, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


_written: dict[str, set[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage by a compressed table in the shared folder, which outlives lost executors. It is deleted by `discard`, or
    with the application's end, as the returned rows may be read until then."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = set()
        atexit.register(_delete, spark, app)
    path = f"{shared_folder(spark)}/corvane-{app}/{uuid.uuid4().hex}"
    _written[app].add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing that is still to be read comes from it."""
    for df in tables:
        path, spark = df._corvane_path, df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written[spark.sparkContext.applicationId].discard(path)


def _delete(spark: SparkSession, app: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written.pop(app, ()):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001, S110 - the session is gone; the folder's owner clears it
        pass
