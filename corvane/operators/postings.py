"""The inverted index: one posting per (word, contract_key), in shards by the word's hash.

Written with `partitionBy("shard_id")` and sorted by word within each file, a search reads only its words' shards and row
groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions.hashing import shard_for_word
from ..functions.scoring import tf_idf
from ..functions.text import with_words
from ..schemas import CONFIG

#: How many words, the most frequent ones, are broadcast with their document counts.
BROADCAST_WORDS = 200_000
#: How many postings, with their snippets, a task should have when they are gathered.
TASK_POSTINGS = 100_000


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): how often each index word stands in each text."""
    words = with_words(df.select(key, text), F.col(text)).select(F.col(key), F.explode("words").alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def scored_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf_idf_score). Every record counts as a document, those without words too; the sizes of documents come
    with their words, the number of documents is a scalar subquery, and document counts join on the word."""
    words = with_words(df.select(key, text), F.coalesce(F.col(text), F.lit("")))
    counted = words.select(F.col(key), F.size("words").alias("total"), F.explode("words").alias("word")).groupBy(key, "total", "word").agg(F.count(F.lit(1)).alias("n"))
    docs = counted.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    all_docs = df.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return counted.join(docs, "word").select(key, "word", tf_idf(F.col("n"), F.col("total"), all_docs, F.col("docs")).alias("tf_idf_score"))


def build_postings(df: DataFrame, key: str, text: str, snippet: str, shards: int = CONFIG.shard_count) -> DataFrame:
    """(shard_id, word, contract_key, snippet, tf_idf_score) of texts; `key` names each text once."""
    scored = scored_words(df, key, text).join(df.select(key, F.coalesce(F.col(snippet), F.lit("")).alias("snippet")), key)
    return scored.select(shard_for_word(F.col("word"), shards).alias("shard_id"), "word", F.col(key).alias("contract_key"), "snippet", "tf_idf_score")


def counted_words(df: DataFrame, key: str, text: str, snippet: str) -> DataFrame:
    """(contract_key, snippet, total, words, counts): each text with its different words and how often each stands in it, counted
    within the row, so that nothing moves; `key` names each text once. Saved, it is what an index is made of in one pass."""
    rows = df.select(F.col(key).alias("contract_key"), F.coalesce(F.col(snippet), F.lit("")).alias("snippet"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = with_words(rows, F.col("_text"), "_words").withColumn("_words", F.sort_array("_words"))
    first = F.transform("_words", lambda w, k: F.when((k == 0) | (w != F.get("_words", k - 1)), k))
    starts = found.withColumn("total", F.size("_words")).withColumn("_starts", F.filter(first, lambda k: k.isNotNull()))
    counts = F.transform("_starts", lambda s, k: F.coalesce(F.get("_starts", k + 1), F.col("total")) - s)
    return starts.select("contract_key", "snippet", "total", F.transform("_starts", lambda s: F.get("_words", s)).alias("words"), counts.alias("counts"))


def word_docs(counted: DataFrame) -> DataFrame:
    """(word, docs): in how many texts each word stands."""
    return counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))


def counted_postings(counted: DataFrame, docs: DataFrame, key: str = "contract_key", also: tuple[str, ...] = ("snippet",), shards: int = CONFIG.shard_count, most: int = BROADCAST_WORDS, held: DataFrame | None = None) -> DataFrame:
    """(shard_id, word, key, *also, tf_idf_score) of `counted_words` and their `word_docs`, both saved: they are read several
    times. The `most` most frequent words are broadcast, so their postings don't move; those of the other words, each of which
    stands in few texts, are joined, and get the columns of their text last. With `held`, only the postings of its keys."""
    all_docs = F.lit(counted.count())
    rows = docs.groupBy(F.length(F.bin("docs")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()  # no more than a long has bits
    least, n = 0, 0
    for r in rows:
        n += r["n"]
        if n > most:
            least = 1 << r["bits"]
            break
    named = counted.where(F.col(key).isNotNull())
    named = named if held is None else named.join(held, key, "left_semi")
    score = tf_idf(F.col("n"), F.col("total"), all_docs, F.col("docs")).alias("tf_idf_score")
    out = [shard_for_word(F.col("word"), shards).alias("shard_id"), "word", key, *also, score]
    single = lambda *cols: named.select(*cols, "total", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(*cols, "total", "w.words", "w.counts").toDF(*cols, "total", "word", "n")
    frequent = F.broadcast(docs.where(F.col("docs") >= least))
    common = single(key, *also).join(frequent, "word").select(*out)
    if not least:
        return common
    other = single(key).join(frequent.select("word"), "word", "left_anti").join(docs.where(F.col("docs") < least), "word").select(key, "word", "n", "total", "docs")
    return common.unionByName((other.join(named.select(key, *also), key) if also else other).select(*out))


def submitted_postings(df: DataFrame, key: str, text: str, snippet: str, score: int = CONFIG.submitted_score) -> DataFrame:
    """As a contributor submits them: every occurrence of a word, with one constant score, to be merged by the shards."""
    words = with_words(df.select(key, text, snippet), F.col(text)).select(F.col(key).alias("contract_key"), F.coalesce(F.col(snippet), F.lit("")).alias("snippet"), F.explode("words").alias("word"))
    return words.select(shard_for_word(F.col("word")).alias("shard_id"), "word", "contract_key", "snippet", F.lit(score).cast("long").alias("tf_idf_score"))


def shard_merge(*states: DataFrame) -> DataFrame:
    """Max-wins union: per (word, contract_key) the highest score with its snippet, of equal ones the smallest snippet. Moved and
    sorted by key first, a text's equal snippets lie together and are compressed away."""
    both = reduce(DataFrame.unionByName, states).repartition("contract_key")
    best = both.groupBy("contract_key", "shard_id", "word").agg(F.min(F.struct((-F.col("tf_idf_score")).alias("s"), "snippet")).alias("b"))
    return best.select("shard_id", "word", "contract_key", F.col("b.snippet").alias("snippet"), (-F.col("b.s")).alias("tf_idf_score"))


def shard_delta_reason(deltas: DataFrame, shards: int = CONFIG.shard_count) -> DataFrame:
    """The deltas with `reject_reason`, null for valid ones."""
    rules = [
        ("no flood token", (F.coalesce(F.octet_length("nonce"), F.lit(0)) == 0) | (F.coalesce("difficulty", F.lit(0)) == 0)),
        ("empty word", F.coalesce("word", F.lit("")) == ""),
        ("wrong shard", ~F.col("shard_id").eqNullSafe(shard_for_word(F.col("word"), shards))),
    ]
    return deltas.withColumn("reject_reason", F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def shard_violations(postings: DataFrame, shards: int = CONFIG.shard_count) -> DataFrame:
    """(shard_id, word, rule) for every broken invariant of shard states."""
    wrong = postings.where(F.col("shard_id") != shard_for_word(F.col("word"), shards)).select("shard_id", "word", F.lit("wrong shard").alias("rule")).distinct()
    twice = postings.groupBy("shard_id", "word", "contract_key").count().where("count > 1").select("shard_id", "word", F.lit("repeated contract key").alias("rule")).distinct()
    return wrong.union(twice)


def shard_batches(postings: DataFrame) -> DataFrame:
    """(contract_key, shard_id, entries): what a contributor sends to each shard for one text."""
    return postings.groupBy("contract_key", "shard_id").agg(F.count(F.lit(1)).alias("entries"))


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    postings.repartitionByRange(F.col("shard_id"), F.col("word")).sortWithinPartitions("shard_id", "word").write.mode(mode).partitionBy("shard_id").parquet(path)


def write_segments(postings: DataFrame, path: str, key: str) -> None:
    """An index of segments, one a task, in folders by shard and sorted by word: nothing moves, and a search still reads only its
    shards and row groups."""
    postings.sortWithinPartitions("shard_id", "word", key).write.option("compression", "zstd").partitionBy("shard_id").parquet(path)


def nested_shards(postings: DataFrame, part: int = 10_000) -> DataFrame:
    """(shard_id, word, part, entries) in canonical order, for export. A word of very many entries comes in parts of about `part`,
    so that none is gathered into one row."""
    sizes = postings.groupBy("shard_id", "word").agg((F.floor(F.count(F.lit(1)) / part) + 1).alias("parts")).where("parts > 1")
    several = postings.join(F.broadcast(sizes), ["shard_id", "word"], "left")  # at most one word for `part` postings
    placed = several.withColumn("part", F.pmod(F.xxhash64("contract_key"), F.coalesce("parts", F.lit(1))).cast("int"))
    placed = placed.repartition("shard_id", "word", "part")  # in the order of the texts: sorted first, equal snippets would lie apart and not be compressed away
    return placed.groupBy("shard_id", "word", "part").agg(F.sort_array(F.collect_list(F.struct("contract_key", "snippet", "tf_idf_score"))).alias("entries"))


def batched(postings: DataFrame, batch: int) -> GroupedData:
    """Postings grouped by shard and part of at most about `batch`. A text's postings move to the same task, where their equal
    snippets are compressed away, and a task holds about `TASK_POSTINGS`."""
    tasks = postings.count() // TASK_POSTINGS + 1
    placed = postings.withColumn("place", F.pmod(F.xxhash64("contract_key"), F.lit(tasks)))
    sizes = placed.groupBy("shard_id", "place").agg((F.floor(F.count(F.lit(1)) / batch) + 1).alias("parts"))  # a row a task and shard
    parted = placed.repartition(tasks, "place").join(F.broadcast(sizes), ["shard_id", "place"])
    return parted.groupBy("shard_id", "place", F.pmod(F.xxhash64("word", "contract_key"), "parts").alias("part"))
