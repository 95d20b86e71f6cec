"""A mixture of sources in which each has its target share of all tokens, by weighted fair queueing.

Each text is one packet of its source's queue, its size in tokens. The queue is shuffled by a hash of the text; a source
that may repeat is queued again, in another order, up to the number of repeats. A packet's virtual finish time is the number
of its source's tokens so far divided by the source's target weight. Taken in the order of finish times, over any stretch
the sources have had tokens in proportion to their weights. The order is cut at the total budget.

A text that stands in several rows is one packet: of its rows with a target, the one of smallest id stands for it, so no text
comes more often than its source may repeat it.

Plan: texts are counted and hashed where they are read; only (hash, id, source, size) moves. The running sums of a queue
are taken in two steps - sums of `SLICES` hash ranges per source and pass, which the window over few rows adds up, then a
window within each range - so a source that holds a third of all rows is spread over its ranges. The cut by budget works
the same way on ranges of finish times. The final order is a range partitioning.

Defined results: texts that are null, empty or of no tokens, rows without a source, and rows of sources without a target
have no packet. Sources with a target but no text have a share of 0, and the others share in proportion to their targets.
The default budget is the largest at which every source still keeps its share: the smallest of (repeats x tokens / weight)
times the sum of weights. With a larger one, exhausted sources fall short and the reached shares say so. A target of 0 or
null takes no part; repeats below 1 or null count as 1. Equal finish times are ordered by source and hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import VOCABULARY, token_count

#: Ranges of hashes per source and pass, and of finish times over all.
SLICES = 1024
#: Targets there may be: they are sent to every task.
MOST_SOURCES = 10_000


def _slice(x: Column) -> Column:
    """The range of a 64-bit hash, in the order of the hash."""
    return F.shiftright(x, 54).cast("int") + SLICES // 2


def packets(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(text_hash, doc_id, source, n_tokens, weight, repeats): one row per text. `targets` has a row per source, few in all."""
    if len(targets.take(MOST_SOURCES + 1)) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    wanted = targets.where("target_share > 0 AND source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("weight"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("repeats"))
    rows = documents.where("text IS NOT NULL AND text <> '' AND source IS NOT NULL").join(F.broadcast(wanted), "source")
    sized = rows.select(F.sha2("text", 256).alias("digest"), "doc_id", "source", token_count(F.col("text"), vocabulary).cast("long").alias("n_tokens"), "weight", "repeats")
    best = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens", "weight", "repeats")).alias("p"))
    return materialize(best.select(F.xxhash64("digest").alias("text_hash"), "p.*").where("n_tokens > 0"))


def mixture(queue: DataFrame, budget: int | None = None) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens, finish): the packets taken, in order; `position` is the number of tokens
    before each. `queue` is what `packets` gives."""
    of_source = queue.groupBy("source", "weight", "repeats").agg(F.sum("n_tokens").alias("tokens"))
    sums = of_source.collect()  # a row per source of the target table
    if not sums:
        return queue.select(F.lit(0).cast("long").alias("position"), "doc_id", "source", F.lit(1).alias("copy"), "n_tokens", F.lit(0.0).alias("finish"))
    if budget is None:
        budget = int(min(r.tokens * r.repeats / r.weight for r in sums) * sum(r.weight for r in sums))
    # The latest finish time that can lie within the budget: passes and packets beyond it are not built at all.
    until = _latest(sums, budget) + max((r.tokens / r.weight for r in sums), default=0) * 1e-9
    passes = {r.source: min(r.repeats, int(until * r.weight / r.tokens) + 1) for r in sums}
    plan = queue.sparkSession.createDataFrame([(r.source, passes[r.source], r.tokens) for r in sums], "source string, passes int, total long")
    copies = queue.join(F.broadcast(plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), "passes"))).withColumn("at", F.xxhash64("text_hash", "copy")).withColumn("slice", _slice(F.col("at")))
    before = (
        copies.groupBy("source", "copy", "slice").agg(F.sum("n_tokens").alias("t"))
        .withColumn("before", F.sum("t").over(W.partitionBy("source", "copy").orderBy("slice")) - F.col("t")).drop("t")
    )  # fmt: skip  - at most SLICES rows per source and pass
    within = F.sum("n_tokens").over(W.partitionBy("source", "copy", "slice").orderBy("at", "text_hash", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    so_far = (F.col("copy") - 1) * F.col("total") + F.col("before") + within
    # The join and the window both need the rows of a slice together: one shuffle.
    timed = copies.join(before, ["source", "copy", "slice"]).withColumn("finish", so_far / F.col("weight")).where(F.col("finish") <= until)
    timed = materialize(timed.select("doc_id", "source", "copy", "n_tokens", "at", "finish", F.least(F.lit(SLICES * 4 - 1), F.floor(F.col("finish") / until * SLICES * 4)).cast("int").alias("range")))
    offset = timed.groupBy("range").agg(F.sum("n_tokens").alias("t")).withColumn("offset", F.sum("t").over(W.orderBy("range")) - F.col("t")).drop("t")  # few rows
    order = W.partitionBy("range").orderBy("finish", "source", "at", "doc_id")
    placed = timed.join(offset, "range").withColumn("position", F.col("offset") + F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens"))
    return placed.where(F.col("position") + F.col("n_tokens") <= budget).select("position", "doc_id", "source", "copy", "n_tokens", "finish")


def _latest(sums: list, budget: int) -> float:
    """The virtual time at which all sources together, each up to its repeats, have had `budget` tokens."""
    left, time = float(budget), 0.0
    open_ = sorted((r.tokens * r.repeats / r.weight, r.weight) for r in sums)
    while open_:
        rate = sum(w for _, w in open_)
        step = open_[0][0] - time
        if step * rate >= left:
            return time + left / rate
        left -= step * rate
        time = open_.pop(0)[0]
    return time


def shares(mixed: DataFrame, queue: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, texts, most_copies): what each source of the targets reached."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"), F.max("copy").alias("most_copies"))
    all_tokens = mixed.agg(F.sum("n_tokens")).scalar()
    joined = targets.where("source IS NOT NULL").select("source", "target_share").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("source", "target_share", zero("tokens"), F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0)).alias("share"), zero("texts"), zero("most_copies"))
