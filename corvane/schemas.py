"""Table schemas and the engine's parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the data model: deployed catalog parameters, limits and summary sizes."""

    protocol_version: int = 1
    shard_count: int = 16
    confirmation_threshold: int = 3
    entry_ttl_days: int = 90
    title_bytes: int = 256
    description_bytes: int = 1024
    title_chars: int = 256
    description_chars: int = 1024
    snippet_bytes: int = 2000
    mini_snippet_chars: int = 300
    html_head_bytes: int = 10_240
    bloom_bits: int = 8192
    bloom_hashes: int = 7
    max_results: int = 50
    submitted_score: int = 10_000
    pow_difficulty: int = 16


CONFIG = Config()

POSTING = "shard_id short, word string, contract_key string, snippet string, tf_idf_score long"
SHARD_DELTA = "shard_id short, word string, contract_key string, snippet string, tf_idf_score long, nonce binary, difficulty short"
ATTESTATION = "contract_key string, metadata_hash string, contributor_pubkey string, nonce binary, difficulty short, token_created_at long"
VARIANT = "contract_key string, metadata_hash string, title string, description string, mini_snippet string"
ENVELOPE = "contract_key string, size_bytes long, version long, first_seen long, last_seen long"
CONTRIBUTOR = "pubkey string, trust_score long, total_contributions long"
CATALOG_DELTA = (
    "contract_key string, title string, description string, mini_snippet string, snippet string, size_bytes long, version long, "
    "metadata_hash string, contributor_pubkey string, nonce binary, difficulty short, token_created_at long"
)
APP_ENTRY = "contract_key string, title string, description string, first_seen long, last_seen long, size_bytes long, subscribers long, version long"
CONTRIBUTION = "contract_key string, ts_ms long, status string, error string"
