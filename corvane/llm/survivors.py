"""The surviving record of each group of duplicates, field by field.

Every attribute is chosen by the maximum of one composite struct - usable first, then its priorities, then the smaller id -
so all attributes of all groups come out of a single aggregation with map-side combining: a group that holds a third of
all rows sends one row per task and field set, and no sort or window gathers it.

Defined results: a group is two or more records with the same key text, letter case and outer blanks aside; a null, empty
or blank key text makes no group. Null priorities count as 0. A field that no record of the group has gives no row. Ties
go to the smaller id. Repeated rows of one id are brought down to the current one before. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_text(text: Column) -> Column:
    """The text without letter case and outer white space of any kind; null if nothing is left."""
    blanks = r"[\p{IsWhite_Space}\x1c-\x1f]+"
    t = F.lower(F.regexp_replace(text, rf"^{blanks}|{blanks}$", ""))
    return F.when(t != "", t)


def _best(df: DataFrame, key: str, group: Column, fields: Mapping[str, tuple[Column, Sequence[Column]]], values: Mapping[str, Column]) -> DataFrame:
    """(_group, _n, _first, _field...): of each group the best struct of each field; a field of `values` carries its value along."""

    def composite(name: str) -> Column:
        has, by = fields[name]
        parts = [has.alias("has"), *[p.alias(f"p{k}") for k, p in enumerate(by)], (-F.col(key)).alias("id")]
        return F.struct(*parts, *([values[name].alias("value")] if name in values else [])).alias(f"_{name}")

    rows = df.select(F.col(key).alias("_id"), group.alias("_group"), *map(composite, fields))
    best = rows.where(F.col("_group").isNotNull()).groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), *[F.max(f"_{name}").alias(f"_{name}") for name in fields])
    return best.where("_n >= 2")


def survivors(df: DataFrame, key: str, group: Column, fields: Mapping[str, tuple[Column, Sequence[Column]]]) -> DataFrame:
    """(group_id, field, id): for each group of two or more and each field, the record it comes from. `fields` gives for each
    name whether a record has the field, and the priorities by which records that have it are ordered, highest first."""
    chosen = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"_{name}.has").alias("has"), (-F.col(f"_{name}.id")).alias("id")) for name in fields])
    best = _best(df, key, group, fields, {})
    return best.select(F.col("_first").alias("group_id"), F.explode(chosen).alias("c")).where("c.has").select("group_id", F.col("c.field").alias("field"), F.col("c.id").alias("id"))


def survivor_values(df: DataFrame, key: str, group: Column, fields: Mapping[str, tuple[Column, Sequence[Column]]], values: Mapping[str, Column]) -> DataFrame:
    """(group_id, field...): the values of the surviving records themselves, out of the same single aggregation; null for a field
    that the whole group lacks."""
    best = _best(df, key, group, fields, values)
    return best.select(F.col("_first").alias("group_id"), *[F.when(F.col(f"_{name}.has"), F.col(f"_{name}.value")).alias(name) for name in values])


def _app_fields(apps: DataFrame, variants: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, list[Column]]]]:
    """Apps with the weight of their key's variants, and by what each field is chosen."""
    weights = variants.groupBy(F.col("contract_key").alias("_key")).agg(F.sum("total_weight").alias("_weight"))
    joined = apps.withColumn("_described", F.coalesce("description", F.lit("")) != "").join(weights, F.col("contract_key") == F.col("_key"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    described = F.col("_described")
    return joined, {
        "record": (F.lit(True), [described.cast("int"), zero("_weight"), zero("size_bytes"), zero("version")]),
        "description": (described, [zero("_weight")]),
        "size_bytes": (F.col("size_bytes").isNotNull(), [F.col("size_bytes")]),
        "version": (F.col("version").isNotNull(), [F.col("version")]),
    }


def app_survivors(apps: DataFrame, variants: DataFrame) -> DataFrame:
    """(group_app_id, field, app_id) of apps with the same title; the weight of an app sums its key's variants."""
    joined, fields = _app_fields(apps, variants)
    return survivors(joined, "app_id", group_text(F.col("title")), fields).select(F.col("group_id").alias("group_app_id"), "field", F.col("id").alias("app_id"))


def surviving_records(apps: DataFrame, variants: DataFrame) -> DataFrame:
    """One built record per group: (group_app_id, contract_key, title, description, size_bytes, version), each value from the
    app that survives for it. A field that the whole group lacks is null."""
    joined, fields = _app_fields(apps, variants)
    values = {"record": F.struct("contract_key", "title"), "description": F.col("description"), "size_bytes": F.col("size_bytes"), "version": F.col("version")}
    built = survivor_values(joined, "app_id", group_text(F.col("title")), fields, values)
    return built.select(F.col("group_id").alias("group_app_id"), "record.contract_key", "record.title", "description", "size_bytes", "version")
