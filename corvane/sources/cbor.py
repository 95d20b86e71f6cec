"""States, deltas and filters in their CBOR wire form, read into tables and written from them.

Each blob is decoded once, in Arrow batches, into a struct of arrays; rows come out by native explodes, so one pass over the
blobs serves each table. Bytes may come as byte strings or as arrays of small numbers, which is how states are written.
"""

from __future__ import annotations

import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.postings import batched
from ..schemas import CONFIG

_NONE = (1 << 64) - 1  # "never seen" in unsigned times


class Malformed(ValueError):
    """Not one well-formed item."""


class Raw(bytes):
    """Bytes that are encoded already."""


def decode(raw: bytes) -> Any:
    """The item that `raw` consists of. Maps become lists of pairs if a key isn't text, else dicts."""
    try:
        item, end = _item(memoryview(raw), 0, 0)
    except (IndexError, struct.error, UnicodeDecodeError, RecursionError) as e:
        raise Malformed(str(e)) from e
    if end != len(raw):
        raise Malformed("bytes after the item")
    return item


def first_item(raw: bytes) -> Any:
    """The item that `raw` begins with, whatever follows."""
    try:
        return _item(memoryview(raw), 0, 0)[0]
    except (IndexError, struct.error, UnicodeDecodeError, RecursionError) as e:
        raise Malformed(str(e)) from e


def _length(raw: memoryview, at: int, low: int) -> tuple[int | None, int]:
    if low < 24:
        return low, at
    if low == 31:
        return None, at
    if low > 27:
        raise Malformed(f"length {low}")
    size = 1 << low - 24
    if at + size > len(raw):
        raise Malformed("cut short")
    return int.from_bytes(raw[at : at + size], "big"), at + size


def _item(raw: memoryview, at: int, depth: int) -> tuple[Any, int]:
    if depth > 64:
        raise Malformed("nested too deep")
    kind, low = raw[at] >> 5, raw[at] & 31
    if kind == 7:
        if low == 25:
            return struct.unpack_from(">e", raw, at + 1)[0], at + 3
        if low == 26:
            return struct.unpack_from(">f", raw, at + 1)[0], at + 5
        if low == 27:
            return struct.unpack_from(">d", raw, at + 1)[0], at + 9
        if low in (20, 21, 22, 23):
            return {20: False, 21: True}.get(low), at + 1
        raise Malformed(f"simple value {low}")
    n, at = _length(raw, at + 1, low)
    if kind in (0, 1, 6) and n is None:
        raise Malformed("number without end")
    if kind == 0:
        return n, at
    if kind == 1:
        return -1 - n, at  # type: ignore[operator]
    if kind == 6:
        return _item(raw, at, depth + 1)
    if kind in (2, 3):
        if n is None:
            parts = []
            while raw[at] != 0xFF:
                part, at = _item(raw, at, depth + 1)
                parts.append(part)
            return (b"" if kind == 2 else "").join(parts), at + 1
        if at + n > len(raw):
            raise Malformed("cut short")
        body = bytes(raw[at : at + n])
        return body if kind == 2 else body.decode(), at + n
    out = []
    while n is None or len(out) < n * (kind - 3):
        if n is None and raw[at] == 0xFF:
            at += 1
            break
        x, at = _item(raw, at, depth + 1)
        out.append(x)
    if kind == 4:
        return out, at
    pairs = list(zip(out[::2], out[1::2], strict=True))
    return dict(pairs) if all(isinstance(k, str) for k, _ in pairs) else pairs, at


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    size = next(s for s in (1, 2, 4, 8) if n < 1 << 8 * s)
    return bytes([kind << 5 | 24 + size.bit_length() - 1]) + n.to_bytes(size, "big")


def pairs_blob(pairs: list[tuple[Any, Any]]) -> bytes:
    """A map with keys of any kind, as encoded."""
    return _head(5, len(pairs)) + b"".join(encode(k) + encode(v) for k, v in pairs)


def encode(x: Any) -> bytes:
    """Plain items; what `pairs_blob` gives goes in as `Raw`."""
    if isinstance(x, Raw):
        return bytes(x)
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, bytes | bytearray):
        return _head(2, len(x)) + bytes(x)
    if isinstance(x, str):
        return _head(3, len(x.encode())) + x.encode()
    if isinstance(x, list | tuple):
        return _head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    raise TypeError(type(x).__name__)


def _bytes(x: Any) -> bytes:
    return bytes(x) if isinstance(x, list | tuple) else x


def _long(x: int | None) -> int | None:
    return None if x is None or x >= 1 << 63 else x


def _pairs(x: Any) -> list[tuple[Any, Any]]:
    return list(x.items()) if isinstance(x, dict) else x


def _attestation(key: str, variant: bytes, a: dict) -> dict:
    token = a["antiflood_token"]
    return {"contract_key": key, "metadata_hash": variant.hex(), "contributor_pubkey": _bytes(a["contributor_pubkey"]).hex(), "nonce": _bytes(token["nonce"]), "difficulty": token["difficulty"], "token_created_at": _long(a["token_created_at"]), "weight": a["weight"]}


def _catalog(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    state, out = decode(raw), {"attestations": [], "variants": [], "envelopes": [], "contributors": []}
    for key, e in _pairs(state["entries"]):
        out["envelopes"].append({"contract_key": key, "size_bytes": _long(e["size_bytes"]), "version": _long(e["version"]), "first_seen": None if e["first_seen"] == _NONE else _long(e["first_seen"]), "last_seen": _long(e["last_seen"])})
        for variant, v in _pairs(e["hash_variants"]):
            digest = _bytes(variant)
            out["variants"].append({"contract_key": key, "metadata_hash": digest.hex(), "title": v["title"], "description": v["description"], "mini_snippet": v["mini_snippet"], "total_weight": v["total_weight"]})
            out["attestations"] += [_attestation(key, digest, a) for a in v["attestations"]]
    out["contributors"] = [{"pubkey": _bytes(c["pubkey"]).hex(), "trust_score": c["trust_score"], "total_contributions": c["total_contributions"]} for _, c in _pairs(state["contributors"])]
    return out


def _shard(raw: bytes | None) -> list[dict] | None:
    if raw is None:
        return None
    state = decode(raw)
    return [{"shard_id": state["shard_id"], "word": w, **{k: t[k] for k in ("contract_key", "snippet", "tf_idf_score")}} for w, ts in _pairs(state["index"]) for t in ts]


def _some(raw: bytes | None) -> list[dict]:
    """One delta or a list of deltas."""
    item = decode(raw) if raw else []
    return item if isinstance(item, list) else [item]


def _catalog_deltas(raw: bytes | None) -> list[dict]:
    out = []
    for d in _some(raw):
        row = _attestation(d["contract_key"], _bytes(d["metadata_hash"]), d["attestation"])
        row.pop("weight")
        out.append({**{k: d[k] for k in ("title", "description", "mini_snippet", "snippet")}, "size_bytes": _long(d["size_bytes"]), "version": _long(d["version"]), **row})
    return out


def _shard_deltas(raw: bytes | None) -> list[dict]:
    return [{**{k: e[k] for k in ("word", "contract_key", "snippet", "tf_idf_score")}, "nonce": _bytes(d["antiflood_token"]["nonce"]), "difficulty": d["antiflood_token"]["difficulty"]} for d in _some(raw) for e in d["entries"]]


ATTESTATIONS = "array<struct<contract_key: string, metadata_hash: string, contributor_pubkey: string, nonce: binary, difficulty: smallint, token_created_at: bigint, weight: bigint>>"
VARIANTS = "array<struct<contract_key: string, metadata_hash: string, title: string, description: string, mini_snippet: string, total_weight: bigint>>"
ENVELOPES = "array<struct<contract_key: string, size_bytes: bigint, version: bigint, first_seen: bigint, last_seen: bigint>>"
CONTRIBUTORS = "array<struct<pubkey: string, trust_score: bigint, total_contributions: bigint>>"
POSTINGS = "array<struct<shard_id: smallint, word: string, contract_key: string, snippet: string, tf_idf_score: bigint>>"
CATALOG_DELTAS = "array<struct<contract_key: string, title: string, description: string, mini_snippet: string, snippet: string, size_bytes: bigint, version: bigint, metadata_hash: string, contributor_pubkey: string, nonce: binary, difficulty: smallint, token_created_at: bigint>>"
SHARD_DELTAS = "array<struct<word: string, contract_key: string, snippet: string, tf_idf_score: bigint, nonce: binary, difficulty: smallint>>"


def _decoded(column: Column, kind: str, read) -> Column:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def rows(blobs: pa.Array) -> pa.Array:
        return pa.array([read(b) for b in blobs.to_pylist()], arrow)

    return rows(column)


def catalog_states(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """The tables attestations, variants, envelopes and contributors of catalog states; a malformed state raises."""
    kinds = {"attestations": ATTESTATIONS, "variants": VARIANTS, "envelopes": ENVELOPES, "contributors": CONTRIBUTORS}
    kind = "struct<" + ", ".join(f"{k}: {t}" for k, t in kinds.items()) + ">"
    state = df.select(_decoded(F.col(column), kind, _catalog).alias("s"))
    return {k: state.select(F.inline(F.col("s")[k])) for k in kinds}


def shard_states(df: DataFrame, column: str) -> DataFrame:
    """The postings of shard states."""
    return df.select(F.inline(_decoded(F.col(column), POSTINGS, _shard)))


def catalog_deltas(df: DataFrame, column: str) -> DataFrame:
    """Deltas of update events, each one delta or a list; empty bytes are no delta."""
    return df.select(F.inline(_decoded(F.col(column), CATALOG_DELTAS, _catalog_deltas)))


def shard_deltas(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.inline(_decoded(F.col(column), SHARD_DELTAS, _shard_deltas)))


def filter_bits(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, bit): the set bits of serialized filters."""

    def read(raw: bytes | None) -> list[int] | None:
        if raw is None:
            return None
        f = decode(raw)
        return [8 * k + j for k, b in enumerate(f["bits"]) for j in range(8) if b >> j & 1 and 8 * k + j < f["num_bits"]]

    return df.select(*by, F.explode(_decoded(F.col(column), "array<int>", read)).alias("bit"))


def filter_blob(packed: Column, bits: int = CONFIG.bloom_bits) -> Column:
    """binary: a filter's bytes in the wire form."""

    @F.arrow_udf("binary")
    def blobs(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else encode({"bits": list(r), "num_bits": bits}) for r in rows.to_pylist()], pa.binary())

    return blobs(packed)


def delta_blobs(deltas: DataFrame) -> DataFrame:
    """(contract_key, delta): catalog deltas as they are submitted, one each."""

    @F.arrow_udf("binary")
    def blobs(rows: pa.Array) -> pa.Array:
        out = []
        for d in rows.to_pylist():
            token = {"nonce": list(d["nonce"] or b""), "difficulty": d["difficulty"] or 0}
            attestation = {"contributor_pubkey": list(bytes.fromhex(d["contributor_pubkey"])), "antiflood_token": token, "token_created_at": d["token_created_at"], "weight": 1}
            texts = {k: d[k] for k in ("contract_key", "title", "description", "mini_snippet", "snippet", "size_bytes", "version")}
            out.append(encode({**texts, "metadata_hash": list(bytes.fromhex(d["metadata_hash"])), "attestation": attestation}))
        return pa.array(out, pa.binary())

    return deltas.select("contract_key", blobs(F.struct(*deltas.columns)).alias("delta"))


def catalog_blobs(variants: DataFrame, weighted: DataFrame, envelope: DataFrame, contributors: DataFrame | None = None) -> DataFrame:
    """(contract_key, state): states of one entry each, as they are kept, of variants, weighted attestations and envelopes. One more
    state, of a null key, holds the contributors in parts of about 10,000, if they are given. States merge, so that
    no state has to hold everything."""
    fields = ("contributor_pubkey", "nonce", "difficulty", "token_created_at", "weight")
    atts = weighted.groupBy("contract_key", "metadata_hash").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("attestations"), F.sum("weight").alias("total_weight"))
    kept = variants.select("contract_key", "metadata_hash", "title", "description", "mini_snippet").join(atts, ["contract_key", "metadata_hash"], "left")
    entries = kept.groupBy("contract_key").agg(F.sort_array(F.collect_list(F.struct("metadata_hash", "title", "description", "mini_snippet", "total_weight", "attestations"))).alias("variants"))
    rows = envelope.join(entries, "contract_key", "left").select("contract_key", F.struct("contract_key", "size_bytes", "version", "first_seen", "last_seen", "variants").alias("e"))

    def attestation(a: dict) -> dict:
        token = {"nonce": list(a["nonce"] or b""), "difficulty": a["difficulty"] or 0}
        return {"contributor_pubkey": list(bytes.fromhex(a["contributor_pubkey"])), "antiflood_token": token, "token_created_at": a["token_created_at"], "weight": a["weight"]}

    def variant(v: dict) -> dict:
        return {"title": v["title"] or "", "description": v["description"] or "", "mini_snippet": v["mini_snippet"] or "", "attestations": [attestation(a) for a in v["attestations"] or []], "total_weight": v["total_weight"] or 0}

    @F.arrow_udf("binary")
    def blobs(entries: pa.Array) -> pa.Array:
        out = []
        for e in entries.to_pylist():
            held = pairs_blob([(list(bytes.fromhex(v["metadata_hash"])), variant(v)) for v in e["variants"] or []])
            first = _NONE if e["first_seen"] is None else e["first_seen"]
            entry = {"size_bytes": e["size_bytes"], "version": e["version"], "first_seen": first, "last_seen": e["last_seen"], "hash_variants": Raw(held)}
            out.append(encode({"entries": {e["contract_key"]: entry}, "contributors": {}}))
        return pa.array(out, pa.binary())

    states = rows.where("contract_key IS NOT NULL").select("contract_key", blobs("e").alias("state"))
    if contributors is None:
        return states

    @F.arrow_udf("binary")
    def people(parts: pa.Array) -> pa.Array:
        one = lambda c: {"pubkey": list(bytes.fromhex(c["pubkey"])), "trust_score": c["trust_score"], "total_contributions": c["total_contributions"]}
        return pa.array([encode({"entries": {}, "contributors": Raw(pairs_blob([(list(bytes.fromhex(c["pubkey"])), one(c)) for c in part]))}) for part in parts.to_pylist()], pa.binary())

    size = contributors.agg(F.floor(F.count(F.lit(1)) / 10_000) + 1).scalar()
    part = contributors.groupBy(F.pmod(F.xxhash64("pubkey"), size)).agg(F.sort_array(F.collect_list(F.struct("pubkey", "trust_score", "total_contributions"))).alias("c"))
    return states.unionByName(part.select(F.lit(None).cast("string").alias("contract_key"), people("c").alias("state")))


def shard_blobs(postings: DataFrame, batch: int = 10_000) -> DataFrame:
    """(shard_id, state): states of shards as they are kept, each shard in states of at most about `batch` postings."""
    grouped = batched(postings, batch).agg(F.sort_array(F.collect_list(F.struct("word", "contract_key", "snippet", "tf_idf_score"))).alias("p"))

    @F.arrow_udf("binary")
    def blobs(ids: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for shard, found in zip(ids.to_pylist(), rows.to_pylist(), strict=True):
            index: dict[str, list] = {}
            for r in found:
                index.setdefault(r["word"], []).append({k: r[k] for k in ("contract_key", "snippet", "tf_idf_score")})
            out.append(encode({"shard_id": shard, "index": index}))
        return pa.array(out, pa.binary())

    return grouped.select("shard_id", blobs("shard_id", "p").alias("state"))


def shard_delta_blobs(postings: DataFrame, nonce: bytes = bytes(8), difficulty: int = 1, batch: int = 10_000) -> DataFrame:
    """(shard_id, delta): postings in deltas of at most about `batch` entries, so that no shard is gathered into one row."""
    entries = batched(postings, batch).agg(F.sort_array(F.collect_list(F.struct("word", "contract_key", "snippet", "tf_idf_score"))).alias("entries"))

    @F.arrow_udf("binary")
    def blobs(rows: pa.Array) -> pa.Array:
        return pa.array([encode({"entries": e, "antiflood_token": {"nonce": list(nonce), "difficulty": difficulty}}) for e in rows.to_pylist()], pa.binary())

    return entries.select("shard_id", blobs("entries").alias("delta"))


def parameters_blob() -> bytes:
    c = CONFIG
    return encode({"protocol_version": c.protocol_version, "shard_count": c.shard_count, "confirmation_weight_threshold": c.confirmation_threshold, "entry_ttl_days": c.entry_ttl_days})


def empty_blobs() -> dict[str, bytes]:
    """What a deployment starts from: parameters, an empty catalog, an empty state of each shard."""
    shards = {f"shard-{k}": encode({"shard_id": k, "index": {}}) for k in range(CONFIG.shard_count)}
    return {"parameters": parameters_blob(), "catalog": encode({"entries": {}, "contributors": {}}), **shards}
