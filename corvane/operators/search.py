"""Ranked search: postings of the query's words, summed per key, joined with the catalog, the best ones highlighted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shard_of
from ..functions.scoring import U32_MAX, combined_score, rank_score
from ..functions.text import plain, tokenize_text
from ..schemas import CONFIG


def query_terms(postings: DataFrame, query: str) -> DataFrame | None:
    """(word, times, pos): the query's words, how often each stands in it, and where first; None without words."""
    words = tokenize_text(query)
    rows = [(w, words.count(w), words.index(w)) for w in dict.fromkeys(words)]
    return postings.sparkSession.createDataFrame(rows, "word string, times int, pos int") if rows else None


def matching_postings(postings: DataFrame, query: str, shards: int = CONFIG.shard_count) -> DataFrame:
    """Postings of the query's words. Shards and words are literals, so the scan prunes partitions and row groups; the
    words with their multiplicity, a handful of rows, are broadcast."""
    terms = query_terms(postings, query)
    if terms is None:
        return postings.where(F.lit(False)).withColumns({"times": F.lit(0), "pos": F.lit(0)})
    words = [*dict.fromkeys(tokenize_text(query))]
    at = sorted({shard_of(w, shards) for w in words})
    return postings.where(F.col("shard_id").isin(at) & F.col("word").isin(words)).join(F.broadcast(terms), "word")


def relevance(matches: DataFrame) -> DataFrame:
    """(contract_key, relevance, snippet): scores summed over the words, repeated words counting each time; the first
    snippet that isn't empty in the order of the words."""
    total = F.least(F.sum(F.col("tf_idf_score") * F.col("times")), F.lit(U32_MAX))
    first = F.min(F.when(F.col("snippet") != "", F.struct("pos", "snippet")))
    return matches.groupBy("contract_key").agg(total.alias("relevance"), F.coalesce(first["snippet"], F.lit("")).alias("snippet"))


def search(postings: DataFrame, entries: DataFrame, query: str, limit: int = CONFIG.max_results) -> DataFrame:
    """The best `limit` keys. `entries` has (contract_key, title, description, status, att_count, weighted_att, version);
    a key without entry shows itself as title. Ties go to the smaller key. Only (key, score) is sorted; titles are joined to
    the winners."""
    scored = relevance(matching_postings(postings, query))
    ranked = scored.join(entries.select("contract_key", "status", "att_count", "weighted_att", "version"), "contract_key", "left")
    rank = rank_score(F.coalesce("weighted_att", F.lit(0)), F.coalesce("version", F.lit(0)), F.lit(0), F.coalesce("status", F.lit("Pending")))
    top = (
        ranked.select("contract_key", "relevance", "snippet", F.coalesce("status", F.lit("Pending")).alias("status"), F.coalesce("att_count", F.lit(0)).alias("attestation_count"), rank.alias("rank"))
        .withColumn("combined_score", combined_score(F.col("relevance"), F.col("rank")))
        .orderBy(F.desc("combined_score"), "contract_key").limit(limit)
    )
    shown = entries.select("contract_key", "title", "description").join(F.broadcast(top.select("contract_key")), "contract_key", "left_semi")
    return top.join(F.broadcast(shown), "contract_key", "left").withColumns({"title": F.coalesce("title", "contract_key"), "description": F.coalesce("description", F.lit(""))})


def _is_word(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c) in ("Nl", "No")


def highlight(snippet: str, terms: set[str], most: int = 300) -> str:
    """The snippet with the query's words marked, cut to about `most` bytes around the first of them."""
    if not snippet or not terms:
        return snippet
    out, word, first, size = [], [], None, 0
    for c in [*snippet, ""]:
        if c and _is_word(c):
            word.append(c)
            continue
        if word:
            w = "".join(word)
            if plain(w.lower()) in terms:
                first = size if first is None else first
                w = f"<mark>{w}</mark>"
            out.append(w)
            size += len(w.encode())
            word = []
        out.append(c)
        size += len(c.encode())
    text = "".join(out)
    return around(text, first or 0, most) if size > most else text


def around(text: str, at: int, most: int) -> str:
    """`most` bytes of the text around byte `at`, whole characters, three dots where it is cut."""
    raw, half = text.encode(), most // 2
    if len(raw) <= most:
        return text
    if at <= half:
        a, b = 0, most
    elif at + half >= len(raw):
        a, b = len(raw) - most, len(raw)
    else:
        a, b = at - half, at + half
    inside = lambda k: 0 < k < len(raw) and raw[k] & 0xC0 == 0x80
    while inside(a):
        a += 1
    while inside(b):
        b -= 1
    return ("..." if a > 0 else "") + raw[a:b].decode() + ("..." if b < len(raw) else "")


def highlighted(results: DataFrame, query: str) -> DataFrame:
    """Search results with `highlighted_snippet` in place of `snippet`; Python sees only the limited rows."""
    terms = set(tokenize_text(query))

    @F.pandas_udf("string")
    def mark(snippets: pd.Series) -> pd.Series:
        return snippets.map(lambda s: highlight(s, terms), na_action="ignore")

    return results.withColumn("highlighted_snippet", mark("snippet")).drop("snippet")


def search_or_browse(postings: DataFrame, entries: DataFrame, directory: DataFrame, query: str) -> tuple[str, DataFrame]:
    """("search", results) if the query has any, else ("directory", what the directory lists for it)."""
    from .directory import directory_filter

    results = search(postings, entries, query)
    return ("search", results) if query and not results.isEmpty() else ("directory", directory_filter(directory, query))


def search_all_words(postings: DataFrame, entries: DataFrame, query: str, boost: int = 2, limit: int = CONFIG.max_results) -> DataFrame:
    """Opt-in: keys that hold every word of the query have their relevance multiplied by `boost`."""
    matches = matching_postings(postings, query)
    wanted = len(set(tokenize_text(query)))
    every = matches.groupBy("contract_key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") == wanted).select("contract_key", F.lit(boost).alias("times_all"))
    boosted = relevance(matches).join(every, "contract_key", "left").withColumn("relevance", F.least(F.col("relevance") * F.coalesce("times_all", F.lit(1)), F.lit(U32_MAX)))
    ranked = boosted.join(entries, "contract_key", "left")
    rank = rank_score(F.coalesce("weighted_att", F.lit(0)), F.coalesce("version", F.lit(0)), F.lit(0), F.coalesce("status", F.lit("Pending")))
    return ranked.withColumn("combined_score", combined_score(F.col("relevance"), rank)).select("contract_key", "combined_score").orderBy(F.desc("combined_score"), "contract_key").limit(limit)
