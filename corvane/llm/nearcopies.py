"""Slightly edited copies of each other, by an LSH forest over MinHash signatures of word sets.

Records with equal word sets first make one class with one representative. The forest keeps `TREES` sorted orders of the
representatives, each by a label of `DEPTH` signature values of its own. In an order, records with a long common prefix stand
side by side. The records that share a prefix make a region, and the depth of a region follows how crowded it is: it is the
shortest prefix, of `LEAST` values or more, that at most `REGION` records share; they are each other's candidates. So
depth falls to `LEAST` where records are sparse.

Where even the whole label is shared by more than `REGION` records, the region is dense and grows by itself: it gets `ORDERS`
sorted orders of its own, by labels of `DEEPER` further values, with the same choice of depth. What remains dense after
`LEVELS` such steps shares so many values that its records are copies: they are compared in blocks of about `REGION`, every
block with every other, in as many tasks; none is dropped.

An order is sorted by one range partitioning whose borders fall between regions, so that neighbours meet in one task. Only a
prefix that more records share than a task should hold is cut at the whole label, and a label that is that frequent, which
is dense in any case, at any record. In a task, regions and candidates come from comparing sorted labels as numpy arrays.

A 192-bit sketch travels with each entry, and neighbours whose sketches are too far apart for the threshold (by more than
four standard deviations) end there. What is left is verified exactly on the hashed word sets. Only ids, labels and
sketches are shuffled, never texts.

Chance of finding a pair: at a similarity of 0.70 at least 0.988 in regions of any depth, 0.9999 where depth is `LEAST`.

Defined results: records with a null or empty required text have no partners; a record of no words has none either; equal
word sets have similarity 1; each pair comes once, smaller id first; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_of

TREES, LEAST, DEPTH, REGION, ORDERS, DEEPER, LEVELS = 24, 3, 5, 128, 10, 3, 2
#: Bits of a signature value in a label.
VALUE = 12
SKETCH_BITS = 192
#: Copies of one record beyond which the pairs of a class are made in several tasks.
SPLIT = 4096
_SEED = 20_011


def word_hashes(text: Column) -> Column:
    """array<long>: the hashes of the distinct lower-cased runs of letters and digits, in ascending order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def signature(hashes: Column) -> Column:
    """struct(labels array<long>, sketch array<long>): of a set of at least one hash, each tree's label of `DEPTH` MinHash
    values of `VALUE` bits, the first one highest, and one bit of each of `SKETCH_BITS` further MinHash values."""
    values, bits = TREES * DEPTH, SKETCH_BITS

    @F.arrow_udf("struct<labels: array<bigint>, sketch: array<bigint>>")
    def sign(sets: pa.Array) -> pa.Array:
        rng = np.random.default_rng(_SEED)
        mix, odd = (rng.integers(0, 1 << 63, values + bits, dtype=np.uint64) for _ in range(2))
        odd = odd * np.uint64(2) + np.uint64(1)
        flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])[:-1]
        out = np.empty((len(sets), values + bits), np.uint32)
        if len(sets):
            for k in range(values + bits):
                x = (flat ^ mix[k]) * odd[k]
                x = (x ^ (x >> np.uint64(29))) * odd[-1 - k]
                out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
        sketch = np.packbits(((out[:, values:] * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1)))
        labels = np.zeros((len(out), TREES), np.int64)
        for k in range(DEPTH):  # the low bits of a value are as good as random
            labels = labels << VALUE | (out[:, k:values:DEPTH] * np.uint32(2654435761) >> np.uint32(32 - VALUE)).astype(np.int64)
        return pa.StructArray.from_arrays(list(map(lists, (labels, sketch))), ["labels", "sketch"])

    return sign(hashes)


def _most_bits(threshold: float) -> int:
    differ = (1 - threshold) / 2
    return int(SKETCH_BITS * (differ + 4.2 * (differ * (1 - differ) / SKETCH_BITS) ** 0.5))


_SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
_FOUND = "id_a bigint, id_b bigint, region bigint"


def _near(region: np.ndarray, sketch: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one region, regions standing together, whose sketches are near."""
    left = np.searchsorted(region, region, "right") - np.arange(len(region)) - 1  # later members of the same region
    at, a, b = np.flatnonzero(left > 0), [], []
    step = 1
    while len(at):
        apart = np.bitwise_count((sketch[at] ^ sketch[at + step]).view(np.uint64)).sum(1)
        hit = at[apart <= most_bits]
        a.append(hit)
        b.append(hit + step)
        step += 1
        at = at[left[at] >= step]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("order", "at", "label", "id", "crowd")]
    return [*numbers, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _SKETCH], 1)]


def _regions(order: np.ndarray, label: np.ndarray, crowd: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in sorted order, the number of each one's region at the depth that its crowd asks for, and whether it is
    dense. Where `crowd` is 1, the order is cut at whole labels, where 2, within them."""
    chosen, done = np.zeros(len(label), np.int64), np.zeros(len(label), bool)
    for d in range(least, depth + 1):
        prefix = label >> VALUE * (depth - d)
        new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (order[1:] != order[:-1])])
        run = np.cumsum(new) - 1
        small = (np.bincount(run) <= REGION)[run] & ~done & (crowd <= (d == depth))
        chosen[small] = np.flatnonzero(new)[run[small]] * (depth + 1) + d
        done |= small
    return chosen, ~done


def _sorted_candidates(entries: DataFrame, least: int, depth: int, rows: int, most_bits: int) -> DataFrame:
    """(id_a, id_b, null) of candidates, and (id, null, region) of members of dense regions, from entries (order, label, id, sketch)
    of which there are about `rows`."""
    spark = entries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = VALUE * (depth - least)
    entries = entries.withColumn("at", F.shiftleft(F.shiftright("label", cut), cut))
    most = max(rows // tasks, 4 * REGION)
    often = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*by).collect()
    crowded = often(entries, "order", "at")  # at most as many as there are tasks, and of labels too
    entries = entries.withColumns({"spread": F.lit(0).cast("long"), "crowd": F.lit(0)})
    if crowded:
        known = F.broadcast(spark.createDataFrame([(r["order"], r["at"], 1) for r in crowded], "order long, at long, _prefix int"))
        marked = entries.join(known, ["order", "at"], "left")
        frequent = often(marked.where("_prefix = 1"), "order", "label")
        whole = F.broadcast(spark.createDataFrame([(r["order"], r["label"], 1) for r in frequent], "order long, label long, _label int"))
        crowd = F.coalesce("_prefix", F.lit(0)) + F.coalesce("_label", F.lit(0))
        entries = marked.join(whole, ["order", "label"], "left").withColumn("crowd", crowd)
        entries = entries.withColumns({"at": F.when(F.col("crowd") > 0, F.col("label")).otherwise(F.col("at")), "spread": F.when(F.col("crowd") == 2, F.xxhash64("id")).otherwise(F.col("spread"))})
    ordered = entries.repartitionByRange(tasks, "order", "at", "spread").sortWithinPartitions("order", "at", "label").select("order", "at", "label", "id", "crowd", *_SKETCH)

    def pairs(batches):
        def found(cols):
            order, _, label, ids, crowd, sketch = cols
            region, dense = _regions(order, label, crowd, least, depth)
            a, b = _near(region[~dense], sketch[~dense], most_bits)
            own = ids[~dense]
            a, b = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
            with np.errstate(over="ignore"):
                name = ((order[dense] * np.int64(-7046029254386353131)) ^ label[dense]) * np.int64(-4417276706812531889)
                name = (name ^ (name >> 29)) & ~np.int64(31) | order[dense] & 31  # the tree stays known
            nothing = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nothing(len(a))], names=["id_a", "id_b", "region"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[dense]), nothing(len(name)), pa.array(name)], names=["id_a", "id_b", "region"])

        kept = None
        for batch in batches:
            cols = _columns(batch)
            if kept is not None:
                cols = [np.concatenate(c) for c in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            # What stands behind the last border may go on in the next batch.
            before = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            kept = [c[last:] for c in cols]
            if last:
                yield from found([c[:last] for c in cols])
        if kept is not None and len(kept[0]):
            yield from found(kept)

    return ordered.mapInArrow(pairs, _FOUND)


def _block_candidates(members: DataFrame, most_bits: int) -> DataFrame:
    """(id_a, id_b) of all pairs of a region (region, id, sketch) whose sketches are near, block against block."""
    sizes = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / REGION).cast("int").alias("blocks"))
    placed = members.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = placed.select("*", other).select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", *_SKETCH)

    def side(s, block):
        own = met.where(F.col("own") == F.col(block))
        return own.select("region", "i", "j", F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in _SKETCH])

    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH])
    pairs = side("a", "i").join(side("b", "j"), ["region", "i", "j"]).where((apart <= most_bits) & ((F.col("i") < F.col("j")) | (F.col("id_a") < F.col("id_b"))))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def candidates(signed: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b), each once, of `signed` (id, labels, s0...): pairs that the forest brings together. Written, as what they come
    from is deleted."""
    most_bits = _most_bits(threshold)
    entries = signed.select("id", *_SKETCH, F.posexplode("labels").alias("tree", "label"))
    entries, rows, depths = entries.withColumn("order", F.col("tree").cast("long")), signed.count() * TREES, (LEAST, DEPTH)
    found, steps = [], []
    for level in range(LEVELS + 1):
        step = materialize(_sorted_candidates(entries, *depths, rows, most_bits))
        steps.append(step)
        found.append(step.where("region IS NULL").select("id_a", "id_b"))
        dense = step.where("region IS NOT NULL").select(F.col("id_a").alias("id"), "region").distinct()
        rows = dense.count() * ORDERS
        if not rows:
            break
        own = dense.join(signed, "id")
        if level == LEVELS:
            found.append(_block_candidates(own, most_bits))
            break
        # The labels of other trees, other ones on every level.
        further = F.slice(F.concat("labels", "labels"), F.col("region").bitwiseAND(F.lit(31)).cast("int") + 2 + level * ORDERS, ORDERS)
        entries = own.select("id", "region", *_SKETCH, F.posexplode(further).alias("nth", "label"))
        order = F.xxhash64("region", "nth").bitwiseAND(F.lit(-32)).bitwiseOR(F.col("region").bitwiseAND(F.lit(31)))
        entries = entries.select("id", *_SKETCH, order.alias("order"), F.shiftright("label", VALUE * (DEPTH - DEEPER)).alias("label"))
        depths = (DEEPER - 1, DEEPER)
    out = materialize(reduce(DataFrame.union, found).distinct())
    discard(*steps)
    return out


def near_copy_links(df: DataFrame, key: str, text: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (id_a, id_b, similarity) between representatives of equal word sets, and members (rep, id) of these classes.
    Rows where `text` is null take no part."""
    rows = df.select(F.col(key).alias("id"), text.alias("text")).withColumn("words", word_hashes(F.col("text"))).where(F.size("words") > 0)
    digest = F.unhex(F.sha2(F.concat_ws(",", F.transform("words", lambda w: F.hex(w))), 256)).alias("set")
    signed = rows.withColumn("sig", signature(F.col("words")))
    rows = materialize(signed.select(digest, "id", "text", "sig.labels", *[F.col("sig.sketch")[k].alias(c) for k, c in enumerate(_SKETCH)]))
    reps = rows.groupBy("set").agg(F.min("id").alias("rep"))
    members = materialize(rows.select("set", "id").join(reps, "set").select("rep", "id"))
    signed = rows.drop("set", "text").join(members.where("rep = id").select("id"), "id", "left_semi")
    pairs = candidates(signed, threshold)
    needed = rows.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi")
    words = lambda s: needed.select(F.col("id").alias(f"id_{s}"), word_hashes(F.col("text")).alias(f"words_{s}"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    links = (
        pairs.join(words("a"), "id_a").join(words("b"), "id_b")
        .select("id_a", "id_b", (common / (F.size("words_a") + F.size("words_b") - common)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return links, members


def near_copy_pairs(df: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """(id_a, id_b): all pairs of records at or above the threshold, links expanded to the members of both classes."""
    links, members = near_copy_links(df, key, text, threshold)
    m = lambda s: members.select(F.col("rep").alias(f"id_{s}"), F.col("id").alias(s))
    between = links.join(m("a"), "id_a").join(m("b"), "id_b").select("a", "b")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    copies = members.join(several, "rep")
    first = copies.select("rep", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"))
    second = copies.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"))
    within = first.join(second, ["rep", "part"]).where("a < b").select("a", "b")
    return between.union(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def components(links: DataFrame) -> DataFrame:
    """(id, group): the smallest id that each linked id is connected with. Every round takes the smallest label among the
    neighbours and then the label of that label, so the number of rounds grows with the logarithm of the longest path."""
    edges = materialize(links.select("id_a", "id_b").union(links.select("id_b", "id_a")).toDF("id", "other").distinct())
    held = labels = materialize(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("group")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "group"), "other").groupBy("id").agg(F.min("group").alias("near"))
        step = labels.join(near, "id").select("id", F.col("group").alias("before"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("id").alias("group"), F.col("group").alias("further"))
        after = materialize(step.join(jump, "group", "left").select("id", "before", F.least("group", F.coalesce("further", "group")).alias("group")))
        discard(held)
        held, labels = after, after.select("id", "group")
        if after.where(F.col("before") != F.col("group")).isEmpty():
            discard(edges)
            return labels


def near_copy_groups(df: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """(id, rep, group, links): one row per record that has a copy; `links` counts the representatives its class is linked to."""
    links, members = near_copy_links(df, key, text, threshold)
    links = materialize(links)
    degree = links.select("id_a").union(links.select("id_b")).toDF("rep").groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    grouped = members.join(components(links).toDF("rep", "group"), "rep", "left").join(degree, "rep", "left")
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    out = grouped.join(size, "rep").where("group IS NOT NULL OR copies > 1")
    return out.select("id", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def app_text(apps: DataFrame, variants: DataFrame) -> DataFrame:
    """(app_id, text): title, description and the mini snippet of the key's heaviest variant; null without title or
    description. `variants` may hold outdated rows: they weigh less than the current row of their variant, so none is heaviest."""
    best = variants.groupBy(F.col("contract_key").alias("_key")).agg(F.max(F.struct("total_weight", "variant_id", "mini_snippet")).alias("_best"))
    joined = apps.join(best, F.col("contract_key") == F.col("_key"), "left")
    described = (F.col("title") != "") & (F.col("description") != "")
    return joined.withColumn("_mini", F.col("_best.mini_snippet")).select("app_id", F.when(described, text_of("title", "description", "_mini")).alias("text"))
