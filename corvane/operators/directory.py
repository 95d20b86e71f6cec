"""Browsing: the local cache of apps with what the catalog says, one app per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_apps(types: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys of type WebApp with their cached row, if any, and cached rows whose key has no type yet. `cache` has one row per
    key."""
    apps = types.where("contract_type = 'WebApp'").select("contract_key").distinct()
    return apps.join(cache, "contract_key", "left").unionByName(cache.join(types.select("contract_key"), "contract_key", "left_anti"))


def dedup_by_title(apps: DataFrame) -> DataFrame:
    """One row per lower-case title: with a description first, then `att_count`, size and version, ties to the smaller key.
    Untitled rows all stay. The best row is the maximum of a struct, combined map-side, so a title that very many rows share
    is no burden."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    filled = (F.coalesce("description", F.lit("")) != "").cast("int")
    order = F.struct((-filled).alias("a"), (-zero("att_count")).alias("b"), (-zero("size_bytes")).alias("c"), (-zero("version")).alias("d"), "contract_key")
    best = apps.where("title IS NOT NULL").groupBy(F.lower("title").alias("_t")).agg(F.min(F.struct(order.alias("o"), F.struct(*apps.columns).alias("r"))).alias("m"))
    return best.select("m.r.*").unionByName(apps.where("title IS NULL"))


def directory_filter(apps: DataFrame, query: str) -> DataFrame:
    """Rows whose key, title or description contains the query, letter case aside; an empty query keeps all."""
    if not query:
        return apps
    q = F.lower(F.lit(query))
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return apps.where(has("contract_key") | has("title") | has("description"))


def shown_description(catalog: Column, cached: Column) -> Column:
    return F.coalesce(F.nullif(catalog, F.lit("")), F.nullif(cached, F.lit("")))


def app_directory(types: DataFrame, cache: DataFrame, entries: DataFrame, query: str = "") -> DataFrame:
    """What the directory lists, titled apps first by title, then the rest by key. `entries` has (contract_key, description,
    status, att_count)."""
    facts = entries.select("contract_key", F.col("description").alias("cat_description"), "status", "att_count")
    apps = known_apps(types, cache).join(facts, "contract_key", "left")
    kept = directory_filter(dedup_by_title(apps), query)
    shown = kept.withColumn("description", shown_description(F.col("cat_description"), F.col("description"))).drop("cat_description")
    return shown.withColumn("att_count", F.coalesce("att_count", F.lit(0))).orderBy(F.col("title").isNull(), F.lower("title"), "contract_key")


def discovery_progress(types: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: contracts known, how many are apps, how many of these have a title yet."""
    titled = cache.where("title IS NOT NULL").select("contract_key").distinct().withColumn("titled", F.lit(1))
    app = F.col("contract_type") == "WebApp"
    return types.join(titled, "contract_key", "left").agg(F.count(F.lit(1)).alias("contracts"), F.count_if(app).alias("web_apps"), F.count_if(app & F.col("titled").isNotNull()).alias("titled"))


def upsert_cache(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """The cache after one update per key: an extracted update overwrites title and description even with null, another keeps
    what is known; the first time seen stays, the last moves on."""
    old, new = cache.alias("o"), updates.alias("n")
    text = lambda c: F.when(F.col("n.contract_key").isNull(), F.col(f"o.{c}")).when(F.col("n.extracted"), F.col(f"n.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}"))
    joined = old.join(new, F.col("o.contract_key") == F.col("n.contract_key"), "full")
    return joined.select(
        F.coalesce("n.contract_key", "o.contract_key").alias("contract_key"), text("title").alias("title"), text("description").alias("description"),
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.coalesce("n.size_bytes", "o.size_bytes").alias("size_bytes"), F.coalesce("n.subscribers", "o.subscribers").alias("subscribers"), F.coalesce("n.version", "o.version").alias("version"),
    )


def acknowledge(log: DataFrame) -> DataFrame:
    """The contribution log after an acknowledgement: its newest Submitted record becomes Confirmed."""
    newest = log.where("status = 'Submitted'").agg(F.max(F.struct("ts_ms", "contract_key"))).scalar()
    hit = (F.col("status") == "Submitted") & (F.struct("ts_ms", "contract_key") == newest)
    return log.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "Confirmed").otherwise(F.col("status")))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts_ms"), F.desc("contract_key")).limit(n)
