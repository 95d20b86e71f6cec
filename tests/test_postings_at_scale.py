import pytest
from pyspark.sql import functions as F

from corvane.operators import postings, search

TEXTS = "contract_key string, text string, mini string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    given = [("a", "weather map weather", "sa"), ("b", "chess map", ""), ("c", "the of", "sc"), ("d", None, "sd"), ("e", "Wéather", None), (None, "map 각", "sn")]
    return spark.createDataFrame(given, TEXTS).cache()


@pytest.fixture(scope="module")
def counted(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("counted") / "c")
    postings.counted_words(texts, "contract_key", "text", "mini").withColumn("doc", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def test_nested_shards_move_as_they_come(spark, texts):
    """sorted for a partial aggregation, the postings of a text lay apart when they moved, each with its snippet."""
    nested = postings.nested_shards(postings.build_postings(texts, "contract_key", "text", "mini"), part=1)
    first = plan(nested).split("partial_collect_list", 1)[1]
    assert "REPARTITION_BY_COL" in first.split("Exchange", 1)[1].split("\n", 1)[0]
    assert rows(nested.select("word", F.explode("entries.contract_key"))) == [("chess", "b"), ("map", "a"), ("map", "b"), ("weather", "a"), ("weather", "e")]


@pytest.mark.parametrize("most", [100, 1, 0])
def test_counted_texts_give_the_same_postings(texts, counted, most):
    """also of words that are not broadcast, and of keys held only."""
    want = rows(postings.build_postings(texts, "contract_key", "text", "mini"))
    docs = postings.word_docs(counted)
    got = postings.counted_postings(counted, docs, most=most)
    assert rows(got) == want
    assert rows(postings.counted_postings(counted, docs, most=most, held=texts.where("contract_key = 'b'").select("contract_key"))) == [r for r in want if r[2] == "b"]
    if most == 100:
        assert "Exchange hashpartitioning(contract_key" not in plan(got)


def test_words_are_counted_within_the_row(counted):
    got = {r.contract_key: (r.total, dict(zip(r.words, r.counts, strict=True))) for r in counted.collect()}
    assert {k: got[k] for k in "abcd"} == {"a": (3, {"map": 1, "weather": 2}), "b": (2, {"chess": 1, "map": 1}), "c": (0, {}), "d": (0, {})}
    assert got[None][0] == 2


def test_saved_entries_are_those_of_the_catalog(spark):
    """the catalog that searches read is made from attestations and trust saved once, and moved once; few texts go along."""
    from corvane.plans import queries

    d = "/root/testdata/sf0.001"
    assert rows(queries._saved_entries(spark, d)) == rows(queries._entries(spark, d))
    whole = queries._keyed_variants(spark, d)
    few = queries._keyed_variants(spark, d, "title", "description")
    assert rows(few.drop("total_weight")) == rows(whole.drop("mini_snippet", "total_weight"))
    assert "mini_snippet" not in plan(few)


def test_merged_postings_move_by_key(spark):
    """sorted by shard and word before they moved, and moved again into buckets, postings took their snippets along each time."""
    states = [spark.createDataFrame([(1, "w", k, "s", n)], "shard_id short, word string, contract_key string, snippet string, tf_idf_score long") for k, n in (("k", 1), ("k", 2), ("j", 1))]
    merged = postings.shard_merge(*states)
    moves = [x for x in plan(merged).split("\n") if "Exchange" in x]
    assert len(moves) == 1 and "hashpartitioning(contract_key" in moves[0]
    assert rows(merged) == [(1, "w", "j", "s", 1), (1, "w", "k", "s", 2)]
