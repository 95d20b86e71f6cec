"""The replicated catalog: attestations of metadata variants, merged by commutative rules, and what follows from them.

The fact is one attestation per (contract_key, metadata_hash, contributor_pubkey). All merges are a union and one
aggregation with map-side combining, so any order, grouping or repetition of updates gives the same state. Keys and hashes
are lower-case hex where they came as bytes.

Ties that the data model leaves open: of repeated attestations the earliest token stays, then the smaller nonce; of variants
with equal counts or weights the greatest hash wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import metadata_hash
from ..schemas import CONFIG

ATTESTATION_KEY = ("contract_key", "metadata_hash", "contributor_pubkey")
VARIANT_KEY = ("contract_key", "metadata_hash")


def attestation_union(*states: DataFrame) -> DataFrame:
    """Grow-only set of attestations of all the states."""
    both = reduce(DataFrame.unionByName, states)
    kept = both.groupBy(*ATTESTATION_KEY).agg(F.min(F.struct("token_created_at", "nonce", "difficulty")).alias("t"))
    return kept.select(*ATTESTATION_KEY, "t.nonce", "t.difficulty", "t.token_created_at")


def entry_envelope(*facts: DataFrame) -> DataFrame:
    """(contract_key, size_bytes, version, first_seen, last_seen): largest size and version, earliest and latest time."""
    both = reduce(DataFrame.unionByName, facts)
    return both.groupBy("contract_key").agg(F.max("size_bytes").alias("size_bytes"), F.max("version").alias("version"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def contributor_merge(*tables: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy("pubkey").agg(F.max("trust_score").alias("trust_score"), F.max("total_contributions").alias("total_contributions"))


def variant_counts(attestations: DataFrame) -> DataFrame:
    return attestations.groupBy(*VARIANT_KEY).agg(F.count(F.lit(1)).alias("att_count"))


def _status(best: Column, second: Column, threshold: int) -> Column:
    disputed = (second > 0) & (second * 100 > best * 30)
    return F.when(best < threshold, "Pending").when(disputed, "Disputed").otherwise("Confirmed")


def entry_winner(attestations: DataFrame, threshold: int = CONFIG.confirmation_threshold) -> DataFrame:
    """(contract_key, status, att_count, winner): the status by the counts of the two most attested variants. Variants are
    first brought down to one row per different count, of which even a hot entry has few."""
    per_count = variant_counts(attestations).groupBy("contract_key", "att_count").agg(F.count(F.lit(1)).alias("times"), F.max("metadata_hash").alias("hash"))
    ranked = per_count.groupBy("contract_key").agg(
        F.sum(F.col("att_count") * F.col("times")).alias("total"),
        F.sort_array(F.collect_list(F.struct("att_count", "times", "hash")), asc=False).alias("r"),
    )
    best = F.col("r")[0]
    second = F.when(best["times"] > 1, best["att_count"]).otherwise(F.coalesce(F.get("r", F.lit(1))["att_count"], F.lit(0)))
    return ranked.select("contract_key", _status(best["att_count"], second, threshold).alias("status"), F.col("total").alias("att_count"), best["hash"].alias("winner"))


def entry_status(attestations: DataFrame, threshold: int = CONFIG.confirmation_threshold) -> DataFrame:
    return entry_winner(attestations, threshold).drop("winner")


def contributor_trust(attestations: DataFrame, contributors: DataFrame, threshold: int = CONFIG.confirmation_threshold) -> DataFrame:
    """(pubkey, trust_score, total_contributions), each the greater of its history and what the state shows: trust counts the
    confirmed or disputed entries whose winning variant the contributor attested."""
    won = entry_winner(attestations, threshold).where("status <> 'Pending'").select("contract_key", F.col("winner").alias("metadata_hash"), F.lit(1).alias("won"))
    shown = (
        attestations.select(*ATTESTATION_KEY).join(won, list(VARIANT_KEY), "left").groupBy(F.col("contributor_pubkey").alias("pubkey"))
        .agg(F.sum(F.coalesce("won", F.lit(0))).alias("trust_score"), F.count(F.lit(1)).alias("total_contributions"))
    )
    return contributor_merge(contributors.select("pubkey", "trust_score", "total_contributions"), shown)


def attestation_weights(attestations: DataFrame, contributors: DataFrame) -> DataFrame:
    """The attestations with `weight`: one more than their contributor's trust, one for the unknown."""
    trust = contributors.select(F.col("pubkey").alias("contributor_pubkey"), "trust_score")
    return attestations.join(trust, "contributor_pubkey", "left").withColumn("weight", 1 + F.coalesce("trust_score", F.lit(0))).drop("trust_score")


def variant_weights(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy(*VARIANT_KEY).agg(F.count(F.lit(1)).alias("att_count"), F.sum("weight").alias("total_weight"))


def best_variant(variant_weights: DataFrame) -> DataFrame:
    """(contract_key, metadata_hash, total_weight): the heaviest variant of each entry."""
    best = variant_weights.groupBy("contract_key").agg(F.max(F.struct("total_weight", "metadata_hash")).alias("b"))
    return best.select("contract_key", "b.metadata_hash", "b.total_weight")


def catalog_finalize(attestations: DataFrame, contributors: DataFrame, threshold: int = CONFIG.confirmation_threshold, trust: DataFrame | None = None) -> DataFrame:
    """(contract_key, status, att_count, weighted_att, best_hash, best_weight): contributors, trust, weights and status in one
    pass; status depends on counts alone, so nothing has to be repeated. `trust` is `contributor_trust` where that is saved."""
    weights = variant_weights(attestation_weights(attestations, contributor_trust(attestations, contributors, threshold) if trust is None else trust))
    summed = weights.groupBy("contract_key").agg(F.sum("total_weight").alias("weighted_att"), F.max(F.struct("total_weight", "metadata_hash")).alias("b"))
    status = entry_status(attestations, threshold)
    return status.join(summed, "contract_key").select("contract_key", "status", "att_count", "weighted_att", F.col("b.metadata_hash").alias("best_hash"), F.col("b.total_weight").alias("best_weight"))


def delta_reason(deltas: DataFrame) -> DataFrame:
    """The deltas with `reject_reason`, null for valid ones; the first broken rule in the order of the checks."""
    empty = lambda c: F.coalesce(F.octet_length(F.col(c)), F.lit(0)) == 0
    rules = [
        ("empty contract key", empty("contract_key")),
        ("title too long", F.octet_length("title") > CONFIG.title_bytes),
        ("description too long", F.octet_length("description") > CONFIG.description_bytes),
        ("no flood token", empty("nonce") | (F.coalesce("difficulty", F.lit(0)) == 0)),
        ("zero public key", F.coalesce(F.col("contributor_pubkey"), F.lit("")).rlike("^0*$")),
        ("no token time", F.coalesce("token_created_at", F.lit(0)) == 0),
        ("wrong hash", ~F.col("metadata_hash").eqNullSafe(metadata_hash(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "snippet")]))),
    ]
    return deltas.withColumn("reject_reason", F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def split_deltas(deltas: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Strict, one rejected delta fails the whole batch."""
    marked = delta_reason(deltas)
    valid, rejected = marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")
    if strict and (first := rejected.select("contract_key", "reject_reason").first()):
        raise ValueError(f"rejected delta of {first.contract_key!r}: {first.reject_reason}")
    return valid, rejected


def add_attestations(attestations: DataFrame, deltas: DataFrame) -> DataFrame:
    return attestation_union(attestations, deltas.select(*attestations.columns))


def add_variants(variants: DataFrame, deltas: DataFrame) -> DataFrame:
    """The stored mini snippet is the delta's snippet."""
    new = deltas.select("contract_key", "metadata_hash", "title", "description", F.col("snippet").alias("mini_snippet"))
    return variants.select(new.columns).unionByName(new).groupBy(*VARIANT_KEY).agg(F.max(F.struct("title", "description", "mini_snippet")).alias("v")).select(*VARIANT_KEY, "v.*")


def add_facts(facts: DataFrame, deltas: DataFrame) -> DataFrame:
    """A repeated attestation is dropped, but its time, size and version still count."""
    return entry_envelope(facts, deltas.select("contract_key", "size_bytes", "version", F.col("token_created_at").alias("first_seen"), F.col("token_created_at").alias("last_seen")))


def apply_deltas(attestations: DataFrame, variants: DataFrame, facts: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after valid deltas."""
    return add_attestations(attestations, deltas), add_variants(variants, deltas), add_facts(facts, deltas)


def catalog_violations(variants: DataFrame, attestations: DataFrame) -> DataFrame:
    """(contract_key, metadata_hash, rule) for every broken invariant of a state: variants with `total_weight`, attestations
    with `weight`."""
    row = lambda df, rule: df.select("contract_key", "metadata_hash", F.lit(rule).alias("rule"))
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "mini_snippet")]
    twice = attestations.groupBy(*ATTESTATION_KEY).count().where("count > 1").select(*VARIANT_KEY).distinct()
    sums = attestations.groupBy(*VARIANT_KEY).agg(F.sum("weight").alias("s"))
    return reduce(DataFrame.union, [
        row(variants.where(F.coalesce("contract_key", F.lit("")) == ""), "empty contract key"),
        row(variants.where(F.col("metadata_hash") != metadata_hash(*texts)), "wrong hash"),
        row(twice, "repeated public key"),
        row(variants.join(sums, list(VARIANT_KEY), "left").where(F.col("total_weight") != F.coalesce("s", F.lit(0))), "wrong total weight"),
    ])


def new_variants(candidates: DataFrame, catalog_variants: DataFrame) -> DataFrame:
    """Candidates whose (contract_key, metadata_hash) the catalog lacks."""
    return candidates.join(catalog_variants.select(*VARIANT_KEY), list(VARIANT_KEY), "left_anti")


def expired(entries: DataFrame, now_ms: Column, ttl_days: int = CONFIG.entry_ttl_days) -> DataFrame:
    """Opt-in: entries not seen for `ttl_days` get the status Expired."""
    old = F.col("last_seen") < now_ms - ttl_days * 86_400_000
    return entries.withColumn("status", F.when(old, "Expired").otherwise(F.col("status")))


def nested_state(variants: DataFrame, attestations: DataFrame, envelope: DataFrame, part: int = 10_000) -> DataFrame:
    """(contract_key, size_bytes, ..., part, hash_variants): entries with their variants and their attestations in canonical order,
    for export. A variant's attestations come in parts of about `part`, and an entry in as many rows as its largest variant
    has parts, so that no hot entry is gathered into one row; variants of one row and part hold each attestation once."""
    counted = attestations.groupBy(*VARIANT_KEY).agg((F.floor(F.count(F.lit(1)) / part) + 1).alias("parts"))
    placed = attestations.join(counted, list(VARIANT_KEY)).withColumn("part", F.pmod(F.xxhash64("contributor_pubkey"), "parts").cast("int"))
    atts = placed.groupBy(*VARIANT_KEY, "part").agg(F.sort_array(F.collect_list(F.struct("contributor_pubkey", "nonce", "difficulty", "token_created_at"))).alias("attestations"))
    full = variants.join(atts, list(VARIANT_KEY), "left").withColumn("part", F.coalesce("part", F.lit(0)))
    several = full.groupBy("contract_key", "part").agg((F.floor(F.count(F.lit(1)) / part) + 1).alias("blocks"))
    spread = full.join(several, ["contract_key", "part"]).withColumn("block", F.pmod(F.xxhash64("metadata_hash"), "blocks").cast("int"))
    entries = spread.groupBy("contract_key", "part", "block").agg(F.sort_array(F.collect_list(F.struct("metadata_hash", "title", "description", "mini_snippet", "attestations"))).alias("hash_variants"))
    return envelope.join(entries, "contract_key", "left").withColumns({"part": F.coalesce("part", F.lit(0)), "block": F.coalesce("block", F.lit(0))})
