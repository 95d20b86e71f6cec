"""Integer scores, scaled by 10,000; no floating point anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest unsigned 32-bit number, at which sums of relevance stay.
U32_MAX = 4_294_967_295
STATUS_BONUS = {"Confirmed": 3000, "Pending": 0, "Disputed": -2000, "Expired": -1000}


def _div(a: Column, b: Column | int) -> Column:
    """Integer division of longs; null where the divisor is 0."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def bit_length(x: Column) -> Column:
    """Bits of a non-negative number from its highest one on; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("long")


def scaled_log2(x: Column) -> Column:
    """Of a ratio scaled by 10,000, in whole powers of two counted from 2**13 on."""
    return F.when(x <= 10_000, F.lit(0)).otherwise(F.greatest(bit_length(x) - 14, F.lit(0)) * 10_000).cast("long")


def tf_idf(term_count: Column, total_terms: Column, total_docs: Column, docs_with_term: Column) -> Column:
    tf, ratio = _div(term_count.cast("long") * 10_000, total_terms), _div(total_docs.cast("long") * 10_000, docs_with_term)
    score = _div(tf * (scaled_log2(ratio) + 10_000), 10_000)
    return F.when((total_terms == 0) | (docs_with_term == 0), F.lit(0)).otherwise(score).cast("long")


def log_scale(x: Column) -> Column:
    return bit_length(x) * 500


def rank_score(weighted_attestations: Column, version: Column, subscribers: Column, status: Column) -> Column:
    base = _div(log_scale(weighted_attestations) * 4000 + log_scale(version) * 3000 + log_scale(subscribers) * 3000, 10_000)
    bonus = F.coalesce(*[F.when(status == s, F.lit(b)) for s, b in STATUS_BONUS.items()], F.lit(0))
    return F.greatest(base + bonus, F.lit(0)).cast("long")


def combined_score(relevance: Column, rank: Column) -> Column:
    return _div(relevance.cast("long") * 7000 + rank.cast("long") * 3000, 10_000)
