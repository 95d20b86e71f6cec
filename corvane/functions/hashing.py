"""Digests, shard routing and proof of work, as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def big_endian(x: Column, size: int) -> Column:
    """binary: a non-negative integer in `size` bytes, high byte first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))


def metadata_hash(*texts: Column) -> Column:
    """Lower-case hex of SHA-256 over the texts, each preceded by its byte length in eight bytes. Null if any text is."""
    return F.sha2(F.concat(*[p for t in texts for p in (big_endian(F.octet_length(t), 8), t.cast("binary"))]), 256)


def _leading(digest_hex: Column, digits: int) -> Column:
    return F.conv(F.substring(digest_hex, 1, digits), 16, 10)


def shard_for_word(word: Column, shards: int = 16) -> Column:
    """The first four bytes of the word's SHA-256, as a number, modulo the number of shards."""
    return (_leading(F.sha2(word, 256), 8).cast("long") % shards).cast("short")


def shard_of(word: str, shards: int = 16) -> int:
    """The same for one word on the driver."""
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % shards


def leading_zero_bits(digest_hex: Column) -> Column:
    """How many of the digest's bits are zero before the first one."""
    nibble = F.regexp_instr(digest_hex, F.lit("[^0]"))
    first = F.conv(F.substring(digest_hex.substr(nibble, F.lit(1)), 1, 1), 16, 2)
    return F.when(nibble == 0, F.length(digest_hex) * 4).otherwise((nibble - 1) * 4 + 4 - F.length(first)).cast("int")


def little_endian_nonce(n: Column) -> Column:
    """Hex of a number in eight bytes, low byte first."""
    big = F.lpad(F.lower(F.hex(n)), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])


def proof_of_work(spark: SparkSession, difficulty: int, tries: int | None = None) -> DataFrame:
    """(nonce, token): the smallest number whose eight bytes, hashed alone, begin with `difficulty` zero bits. The range is
    tried in parallel; 64 times the expected number of tries find one but for a chance of e**-64."""
    n = spark.range(tries or 64 << difficulty)
    ok = n.where(leading_zero_bits(F.sha2(F.unhex(little_endian_nonce(F.col("id"))), 256)) >= difficulty)
    return ok.agg(F.min("id").alias("nonce")).select("nonce", little_endian_nonce(F.col("nonce")).alias("token"))
