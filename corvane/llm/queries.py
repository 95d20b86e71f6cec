"""The queries of the training-data operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import fit_labeller, label_blocks, main_content, page_blocks
from .common import current, materialize, table
from .distinctive import SIGNIFICANT, distinctive_cases, distinctive_terms, significant_terms
from .forms import consistent_records, look_alike_groups, look_alikes
from .mixture import mixture, packets, shares
from .nearcopies import app_text, near_copy_groups, near_copy_pairs
from .subjects import subject_posteriors, subjects_found
from .survivors import app_survivors, surviving_records
from .tokens import encode_corpus


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "catalog_variant"), "variant_id", "total_weight")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "page_metadata"), "page_id", "captured_at")


def _apps(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "app_entry"), "app_id", "last_seen")


TEXTS = ("title", "description", "mini_snippet")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    out = distinctive_terms(_variants(spark, d), "variant_id", "contract_key", *TEXTS)
    return out.withColumn("score", F.round("score", 4))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_cases(_variants(spark, d), "variant_id", "contract_key", *TEXTS)


def p1_distinctive(spark: SparkSession, d: str) -> DataFrame:
    return significant_terms(p1_scores(spark, d)).select("variant_id", "term", "score")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    variants = consistent_records(_variants(spark, d), "variant_id", *TEXTS)
    pages = consistent_records(_pages(spark, d), "page_id", "title", "description", "snippet")
    named = lambda df, tab, key: df.select(F.lit(tab).alias("tab"), F.col(key).alias("id"), "title", "description", F.lower(F.hex("metadata_hash")).alias("metadata_hash"))
    return named(variants, "catalog_variant", "variant_id").union(named(pages, "page_metadata", "page_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(tab, look_alikes(rows(spark, d), key, "title", "description")) for tab, rows, key in (("catalog_variant", _variants, "variant_id"), ("page_metadata", _pages, "page_id"))]
    a, b = (df.select(F.lit(tab).alias("tab"), "id_a", "id_b") for tab, df in pairs)
    return a.union(b)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The linear form of `p2_found`: every record of a pair with its class of equal texts and its group of equal looks."""
    variants = look_alike_groups(_variants(spark, d), "variant_id", "title", "description")
    pages = look_alike_groups(_pages(spark, d), "page_id", "title", "description")
    a, b = (df.select(F.lit(tab).alias("tab"), "id", "class_id", "group_id") for tab, df in (("catalog_variant", variants), ("page_metadata", pages)))
    return a.union(b)


def _app_texts(spark: SparkSession, d: str) -> DataFrame:
    apps = current(table(spark, d, "app_entry").select("app_id", "last_seen", "contract_key", "title", "description"), "app_id", "last_seen")
    return app_text(apps, table(spark, d, "catalog_variant"))


def _page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as the labeller's sample, its counts and its application all read it. The partitions by page are asked for,
    as few bytes are much work here and adaptive execution would join them; the choice of the current row needs them anyway."""
    rows = table(spark, d, "page_metadata").select("page_id", "captured_at", "contract_key", "description", "snippet")
    pages = current(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id"), "page_id", "captured_at")
    return materialize(page_blocks(pages, "page_id", "contract_key"))


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = _page_blocks(spark, d)
    return label_blocks(blocks, "page_id", fit_labeller(blocks)).withColumn("furniture", F.round("furniture", 4))


def p3_main(spark: SparkSession, d: str) -> DataFrame:
    blocks = _page_blocks(spark, d)
    return main_content(blocks, "page_id", fit_labeller(blocks))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = _page_blocks(spark, d)
    return label_blocks(blocks, "page_id", fit_labeller(blocks), lines=False).where("furniture >= 0.5").select("page_id", "line_no")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    texts = _app_texts(spark, d)
    out = near_copy_groups(texts, "app_id", F.col("text"), 0.7)
    return out.select(F.col("id").alias("app_id"), F.col("rep").alias("class_app_id"), F.col("group").alias("group_app_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _app_texts(spark, d)
    return near_copy_pairs(texts, "app_id", F.col("text"), 0.7).toDF("app_id_a", "app_id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return app_survivors(_apps(spark, d), _variants(spark, d))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return surviving_records(_apps(spark, d), _variants(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixture(packets(table(spark, d, "documents"), table(spark, d, "mix_target")))
    return mixed.orderBy("position")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_target")
    queue = packets(table(spark, d, "documents"), targets)
    return shares(materialize(mixture(queue)), queue, targets)


def _subject_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject_area"), _apps(spark, d)


def p8_posteriors(spark: SparkSession, d: str) -> DataFrame:
    out = subject_posteriors(*_subject_tables(spark, d))
    return out.withColumns({"share": F.round("share", 4), "posterior": F.round("posterior", 4)})


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    found = subjects_found(*_subject_tables(spark, d))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects_found(*_subject_tables(spark, d))


QUERIES = {f.__name__: f for f in (p1_scores, p1_distinctive, p1_found, p2_forms, p2_found, p2_groups, p3_blocks, p3_main, p3_found, p4_groups, p4_found, p5_found, p5_records, p6_ids, p7_mixture, p7_shares, p8_posteriors, p8_composition, p8_found)}

_VARIANTS = """variants AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY total_weight DESC NULLS LAST, contract_key DESC NULLS LAST,
    metadata_hash DESC NULLS LAST, title DESC NULLS LAST, description DESC NULLS LAST, mini_snippet DESC NULLS LAST) AS r FROM catalog_variant)
  WHERE r = 1)"""
_TERMS = (
    f"WITH {_VARIANTS},"
    + r"""
words AS (
  SELECT variant_id, contract_key, list_filter(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(mini_snippet, '')),
    '[ \t\n\x0B\f\r!-/:-@\[-`{-~]+'), lambda t: t <> '') AS w FROM variants),
counts AS (SELECT variant_id, contract_key, len(w) AS record_terms, t.term, count(*) AS tf FROM words, unnest(w) AS t(term) GROUP BY ALL),
per_term AS (SELECT term, sum(tf)::BIGINT AS total_tf, count(DISTINCT coalesce(contract_key, '')) AS groups FROM counts GROUP BY term),
n AS (SELECT sum(len(w))::DOUBLE AS n FROM words),
cells AS (SELECT variant_id, c.term, tf, record_terms, total_tf, groups, tf::DOUBLE AS a, (total_tf - tf)::DOUBLE AS b, (record_terms - tf)::DOUBLE AS c,
  n - total_tf - record_terms + tf AS d, n FROM counts c JOIN per_term p ON c.term = p.term, n),
scored AS (SELECT *, greatest(0, 2 * (a * ln(a) + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END
  + CASE WHEN d > 0 THEN d * ln(d) ELSE 0 END + n * ln(n) - (a + b) * ln(a + b) - CASE WHEN c + d > 0 THEN (c + d) * ln(c + d) ELSE 0 END
  - (a + c) * ln(a + c) - CASE WHEN b + d > 0 THEN (b + d) * ln(b + d) ELSE 0 END)) * CASE WHEN a * n < (a + b) * (a + c) THEN -1 ELSE 1 END AS score FROM cells)
"""
)
_APPS = """apps AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY last_seen DESC NULLS LAST, contract_key DESC NULLS LAST, title DESC NULLS LAST,
    description DESC NULLS LAST, first_seen DESC NULLS LAST, size_bytes DESC NULLS LAST, subscribers DESC NULLS LAST, version DESC NULLS LAST) AS r FROM app_entry)
  WHERE r = 1)"""
_SURVIVORS = f"""WITH {_APPS}, {_VARIANTS},
weights AS (SELECT contract_key, sum(total_weight) AS w FROM variants GROUP BY contract_key),
keyed AS (SELECT a.app_id, a.contract_key, a.title, a.description, a.size_bytes, a.version, coalesce(w, 0) AS weight,
  lower(regexp_replace(a.title, '^\\s+|\\s+$', '', 'g')) AS k FROM apps a LEFT JOIN weights ON a.contract_key = weights.contract_key),
grouped AS (SELECT *, min(app_id) OVER (PARTITION BY k) AS group_app_id FROM keyed WHERE k <> '' QUALIFY count(*) OVER (PARTITION BY k) > 1),
picked AS (
  SELECT group_app_id, 'record' AS field, app_id FROM grouped QUALIFY row_number() OVER (PARTITION BY k ORDER BY (coalesce(description, '') <> '') DESC,
    weight DESC, coalesce(size_bytes, 0) DESC, coalesce(version, 0) DESC, app_id) = 1
  UNION ALL SELECT group_app_id, 'description', app_id FROM grouped WHERE description <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY weight DESC, app_id) = 1
  UNION ALL SELECT group_app_id, 'size_bytes', app_id FROM grouped WHERE size_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY size_bytes DESC, app_id) = 1
  UNION ALL SELECT group_app_id, 'version', app_id FROM grouped WHERE version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC, app_id) = 1)
"""
SQL = {
    "p1_scores": _TERMS + "SELECT variant_id, term, tf, record_terms, total_tf, groups, round(score, 4) + 0.0 AS score FROM scored",
    "p1_distinctive": _TERMS + f"SELECT variant_id, term, round(score, 4) AS score FROM scored WHERE round(score, 4) > {SIGNIFICANT}",
    "p1_found": _TERMS + "SELECT variant_id, term FROM scored WHERE tf >= 3 AND groups BETWEEN 2 AND 8 AND regexp_matches(term, '^[a-z]{4,}$')",
    "p5_found": _SURVIVORS + "SELECT group_app_id, field, app_id FROM picked",
    "p5_records": _SURVIVORS
    + """SELECT p.group_app_id, max(g.contract_key) FILTER (WHERE field = 'record') AS contract_key, max(g.title) FILTER (WHERE field = 'record') AS title,
  max(g.description) FILTER (WHERE field = 'description') AS description, max(g.size_bytes) FILTER (WHERE field = 'size_bytes') AS size_bytes,
  max(g.version) FILTER (WHERE field = 'version') AS version FROM picked p JOIN grouped g ON p.app_id = g.app_id GROUP BY p.group_app_id""",
}
