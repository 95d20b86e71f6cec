"""The same queries in SQL, as DuckDB runs it over the given tables."""

from __future__ import annotations

import unicodedata

from ..functions.text import STOP_WORDS
from .queries import KNOWN_UNTIL, PART, REPLICA_A_UNTIL, REPLICA_B_FROM, SEARCH

WHITE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _decomposed(x: str) -> str:
    """Kana with a voicing mark, decomposed; their marks are not among those that words lose."""
    for c in map(chr, range(0x3041, 0x30FF)):
        if len(d := unicodedata.normalize("NFD", c)) > 1:
            x = f"replace({x}, '{c}', '{d}')"
    return x


def _jamo(x: str) -> str:
    """Hangul syllables as their letters."""
    n = "(unicode(c) - 44032)"
    letters = f"chr((4352 + {n} // 588)::INTEGER) || chr((4449 + {n} % 588 // 28)::INTEGER) || CASE WHEN {n} % 28 > 0 THEN chr((4519 + {n} % 28)::INTEGER) ELSE '' END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN c BETWEEN '가' AND '힣' THEN {letters} ELSE c END), '')"


def _plain(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[ぁ-ヿ]') THEN {_decomposed(x)} WHEN regexp_matches({x}, '[가-힣]') THEN {_jamo(x)} ELSE strip_accents({x}) END"


def words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"list_filter(list_transform(list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: {_plain('lower(w)')}), lambda w: w <> '' AND w NOT IN ({stop}))"


def shard(word: str) -> str:
    return f"(('0x' || substr(sha256({word}), 1, 8))::UBIGINT % 16)::SMALLINT"


def be(n: str, size: int) -> str:
    return f"unhex(lpad(hex({n}), {2 * size}, '0'))"


def mhash(*texts: str) -> str:
    return "sha256(" + " || ".join(f"{be(f'strlen({t})', 8)} || encode({t})" for t in texts) + ")"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE}+', ' ', 'g'))"


def norm(text: str) -> str:
    return squeezed(f"nfc_normalize(replace({text}, chr(65279), ''))")


def bits(item: str) -> str:
    one = ", ".join(f"(('0x' || substr(sha256(unhex('0{i}') || {item}), 1, 16))::UBIGINT % 8192)::INTEGER" for i in range(7))
    return f"[{one}]"


def bitlen(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin(({x})::BIGINT)) END)"


def tf_idf(n: str, total: str, all_docs: str, docs: str) -> str:
    ratio = f"({all_docs} * 10000 // {docs})"
    idf = f"(CASE WHEN {ratio} <= 10000 THEN 0 ELSE greatest({bitlen(ratio)} - 14, 0) * 10000 END + 10000)"
    return f"({n} * 10000 // {total} * {idf} // 10000)::BIGINT"


def rank(att: str, version: str, status: str) -> str:
    return f"greatest(({bitlen(att)} * 500 * 4000 + {bitlen(version)} * 500 * 3000) // 10000 + CASE {status} WHEN 'Confirmed' THEN 3000 WHEN 'Disputed' THEN -2000 WHEN 'Expired' THEN -1000 ELSE 0 END, 0)::BIGINT"


def cut(text: str, n: int) -> str:
    """At most n bytes, whole characters."""
    return f"CASE WHEN strlen({text}) <= {n} THEN {text} ELSE left({text}, list_max(list_filter(range({n // 4}, {n + 1}), lambda k: strlen(left({text}, k)) <= {n}))) END"


def _picked(table: str, key: str, order: str, rest: str, nulls: str = "NULLS LAST") -> str:
    by = ", ".join(f"{c} DESC {nulls}" for c in (*order.split(), *rest.split()))
    return f"(SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS r FROM {table}) WHERE r = 1)"


VARIANTS = f"""variants AS (SELECT variant_id, contract_key, lower(hex(metadata_hash)) AS metadata_hash, coalesce(title, '') AS title, coalesce(description, '') AS description,
  coalesce(mini_snippet, '') AS mini_snippet, total_weight FROM {_picked('catalog_variant', 'variant_id', 'total_weight', 'contract_key metadata_hash title description mini_snippet')})"""
TEXTS = f"""{VARIANTS}, texts AS (SELECT contract_key, title, description, mini_snippet, title || ' ' || description || ' ' || mini_snippet AS text
  FROM {_picked('variants', 'contract_key', 'total_weight', 'variant_id')})"""
KEYED = f"""{VARIANTS}, keyed AS (SELECT contract_key, metadata_hash, title, description, mini_snippet, total_weight
  FROM {_picked('variants', 'contract_key, metadata_hash', 'title', 'description mini_snippet total_weight')})"""


def att(name: str = "att", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT contract_key, lower(hex(metadata_hash)) AS metadata_hash, lower(hex(contributor_pubkey)) AS contributor_pubkey, nonce, difficulty, token_created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_key, metadata_hash, contributor_pubkey ORDER BY token_created_at NULLS FIRST, nonce NULLS FIRST, difficulty NULLS FIRST) AS r
    FROM catalog_attestation WHERE {where}) WHERE r = 1)"""


A_WHERE, B_WHERE = f"received_at < TIMESTAMPTZ '{REPLICA_A_UNTIL} 00:00:00+00'", f"received_at >= TIMESTAMPTZ '{REPLICA_B_FROM} 00:00:00+00'"


def status(name: str = "status", of: str = "att") -> str:
    return f"""{name}_n AS (SELECT contract_key, metadata_hash, count(*) AS n FROM {of} GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY contract_key ORDER BY n DESC, metadata_hash DESC) AS r FROM {name}_n),
{name} AS (SELECT contract_key, sum(n)::BIGINT AS att_count, max(metadata_hash) FILTER (r = 1) AS winner,
  CASE WHEN max(n) < 3 THEN 'Pending' WHEN coalesce(max(n) FILTER (r = 2), 0) * 100 > max(n) * 30 THEN 'Disputed' ELSE 'Confirmed' END AS status FROM {name}_r GROUP BY contract_key)"""


def trust(name: str = "trust", of: str = "att", by: str = "status") -> str:
    return f"""{name} AS (SELECT pubkey, max(trust_score)::BIGINT AS trust_score, max(total_contributions)::BIGINT AS total_contributions FROM (
  SELECT lower(hex(pubkey)) AS pubkey, trust_score, total_contributions FROM contributor
  UNION ALL SELECT contributor_pubkey, count(s.winner), count(*) FROM {of} a LEFT JOIN {by} s ON a.contract_key = s.contract_key AND a.metadata_hash = s.winner AND s.status <> 'Pending'
  GROUP BY contributor_pubkey) GROUP BY pubkey)"""


def final(name: str = "final", of: str = "att") -> str:
    s, t = f"{name}_s", f"{name}_t"
    return f"""{status(s, of)}, {trust(t, of, s)},
{name}_w AS (SELECT contract_key, metadata_hash, count(*) AS att_count, sum(1 + coalesce(trust_score, 0))::BIGINT AS total_weight
  FROM {of} LEFT JOIN {t} ON contributor_pubkey = pubkey GROUP BY ALL),
{name} AS (SELECT s.contract_key, s.status, s.att_count, w.weighted_att, b.metadata_hash AS best_hash, b.total_weight AS best_weight FROM {s} s
  JOIN (SELECT contract_key, sum(total_weight)::BIGINT AS weighted_att FROM {name}_w GROUP BY 1) w USING (contract_key)
  JOIN (SELECT *, row_number() OVER (PARTITION BY contract_key ORDER BY total_weight DESC, metadata_hash DESC) AS r FROM {name}_w) b ON b.contract_key = s.contract_key AND b.r = 1)"""


ENVELOPE = "envelope AS (SELECT contract_key, max(size_bytes) AS size_bytes, max(version) AS version, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM app_entry GROUP BY 1)"
ENTRIES = f"""{KEYED}, {att()}, {final()}, {ENVELOPE},
entries AS (SELECT f.contract_key, k.title, k.description, f.status, f.att_count, f.weighted_att, e.version FROM final f
  LEFT JOIN keyed k ON k.contract_key = f.contract_key AND k.metadata_hash = f.best_hash LEFT JOIN envelope e ON e.contract_key = f.contract_key)"""


def scored(table: str, key: str, text: str) -> str:
    return f"""split AS (SELECT {key}, {words(f"coalesce({text}, '')")} AS w FROM {table}),
counted AS (SELECT {key}, len(w) AS total, t.word, count(*) AS n FROM split, unnest(w) AS t(word) GROUP BY ALL),
docs AS (SELECT word, count(*) AS docs FROM counted GROUP BY 1),
scored AS (SELECT {key}, c.word, {tf_idf('n', 'total', f'(SELECT count(DISTINCT {key}) FROM {table})', 'docs')} AS tf_idf_score FROM counted c JOIN docs d ON c.word = d.word)"""


POSTINGS = f"""{TEXTS}, {scored('texts', 'contract_key', 'text')},
postings AS (SELECT {shard('word')} AS shard_id, word, contract_key, mini_snippet AS snippet, tf_idf_score FROM scored JOIN texts USING (contract_key))"""
CACHE = f"cache AS (SELECT * FROM {_picked('app_entry', 'contract_key', 'last_seen', 'app_id description first_seen size_bytes subscribers title version')})"
TYPES = "types AS (SELECT contract_key, max(t) AS contract_type FROM (SELECT contract_key, 'WebApp' AS t FROM page_metadata UNION ALL SELECT contract_key, 'Data' FROM documents) WHERE contract_key IS NOT NULL GROUP BY 1)"
_QUERY_WORDS = ["release", "branches", "dependency", "graphs", "release", "seismic", "traces"]
TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {_QUERY_WORDS.count(w)}, {_QUERY_WORDS.index(w)})" for w in dict.fromkeys(_QUERY_WORDS)) + ") AS t(word, times, pos))"
MATCHES = "matches AS (SELECT p.*, times, pos FROM postings p JOIN terms t ON p.word = t.word)"
RELEVANCE = """relevance AS (SELECT contract_key, least(sum(tf_idf_score * times), 4294967295)::BIGINT AS relevance,
  coalesce((min(struct_pack(p := pos, s := snippet)) FILTER (snippet <> '')).s, '') AS snippet FROM matches GROUP BY 1)"""
assert SEARCH.startswith("release branches, dependency graphs and the release of")
BEST_TITLE = "CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0 END DESC, coalesce(att_count, 0) DESC, coalesce(size_bytes, 0) DESC, coalesce(version, 0) DESC, contract_key"
PAGE_HTML = r"""pages AS (SELECT DISTINCT page_id, contract_key, coalesce(title, '') AS t, translate(coalesce(description, ''), '"<>', '') AS d, coalesce(snippet, '') AS s FROM page_metadata)"""
VISIBLE = squeezed(r"regexp_replace(' ' || t || '' || regexp_replace(s, '\n', chr(10), 'g'), '<[^>]*>?|>', '', 'g')")

MARKED = f"""{KEYED}, d AS (SELECT a.contract_key, lower(hex(a.metadata_hash)) AS metadata_hash, lower(hex(contributor_pubkey)) AS contributor_pubkey, nonce, difficulty, token_created_at,
  k.title, k.description, k.mini_snippet AS snippet FROM catalog_attestation a LEFT JOIN keyed k ON a.contract_key = k.contract_key AND lower(hex(a.metadata_hash)) = k.metadata_hash),
marked AS (SELECT *, CASE WHEN coalesce(contract_key, '') = '' THEN 'empty contract key' WHEN strlen(title) > 256 THEN 'title too long' WHEN strlen(description) > 1024 THEN 'description too long'
  WHEN coalesce(octet_length(nonce), 0) = 0 OR coalesce(difficulty, 0) = 0 THEN 'no flood token' WHEN regexp_full_match(contributor_pubkey, '0*') THEN 'zero public key' WHEN coalesce(token_created_at, 0) = 0 THEN 'no token time'
  WHEN {mhash("coalesce(title, '')", "coalesce(description, '')", "coalesce(snippet, '')")} IS DISTINCT FROM metadata_hash THEN 'wrong hash' END AS reject_reason FROM d)"""
IN_A, IN_B = (f"contract_key IN (SELECT contract_key FROM catalog_attestation WHERE {w})" for w in (A_WHERE, B_WHERE))
SEARCHED = f"""{POSTINGS}, {ENTRIES.replace(VARIANTS + ',', '', 1)}, {TERMS}, {MATCHES}, {RELEVANCE},
ranked AS (SELECT r.*, coalesce(status, 'Pending') AS status, coalesce(att_count, 0) AS attestation_count, {rank('coalesce(weighted_att, 0)', 'coalesce(version, 0)', "coalesce(status, 'Pending')")} AS rank,
  coalesce(title, contract_key) AS title, coalesce(description, '') AS description FROM relevance r LEFT JOIN entries USING (contract_key)),
best AS (SELECT *, (relevance * 7000 + rank * 3000) // 10000 AS combined_score FROM ranked ORDER BY combined_score DESC, contract_key LIMIT 50)"""
_WANTED = ", ".join(f"'{w}'" for w in dict.fromkeys(_QUERY_WORDS))

SQL: dict[str, str] = {
    "tokens": f"SELECT doc_id, t.word, count(*) AS n FROM (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL), unnest(w) AS t(word) GROUP BY ALL",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "canonical_text": f"SELECT page_id, left({norm('title')}, 256) AS title, left({norm('description')}, 1024) AS description, left({norm('snippet')}, 2000) AS snippet FROM (SELECT DISTINCT page_id, title, description, snippet FROM page_metadata)",
    "metadata_hash": f"SELECT page_id, h AS hash, h = lower(hex(metadata_hash)) AS as_given FROM (SELECT DISTINCT *, {mhash(*(f'''coalesce({c}, '')''' for c in ('title', 'description', 'snippet')))} AS h FROM page_metadata)",
    "shard_routing": f"SELECT word, {shard('word')} AS shard_id FROM (SELECT DISTINCT t.word FROM (SELECT {words('text')} AS w FROM documents WHERE text IS NOT NULL), unnest(w) AS t(word))",
    "tfidf": f"WITH {scored('documents', 'doc_id', 'text')} SELECT doc_id, word, tf_idf_score FROM scored",
    "rank_score": f"WITH {ENTRIES}, r AS (SELECT contract_key, status, {rank('coalesce(weighted_att, 0)', 'coalesce(version, 0)', 'status')} AS rank FROM entries) SELECT *, (10000 * 7000 + rank * 3000) // 10000 AS combined FROM r",
    "index_postings": f"WITH {POSTINGS} SELECT * FROM postings",
    "shard_batches": f"WITH {TEXTS} SELECT contract_key, {shard('t.word')} AS shard_id, count(*) AS entries FROM (SELECT contract_key, {words('text')} AS w FROM texts), unnest(w) AS t(word) GROUP BY ALL",
    "shard_merge": f"WITH {POSTINGS} SELECT shard_id, word, contract_key, snippet, greatest(tf_idf_score, 100) AS tf_idf_score FROM postings",
    "shard_delta_validate": f"""WITH {POSTINGS}, given AS (SELECT contract_key, nonce, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY contract_key ORDER BY nonce NULLS FIRST, difficulty NULLS FIRST) AS r FROM catalog_attestation) WHERE r = 1)
SELECT ((shard_id + length(word) % 2) % 16)::SMALLINT AS shard_id, word, contract_key, CASE WHEN coalesce(octet_length(nonce), 0) = 0 OR coalesce(difficulty, 0) = 0 THEN 'no flood token' WHEN length(word) % 2 = 1 THEN 'wrong shard' END AS reject_reason
FROM postings JOIN given USING (contract_key)""",
    "shard_validate": f"""WITH {POSTINGS} SELECT DISTINCT 0::SMALLINT AS shard_id, word, 'wrong shard' AS rule FROM postings WHERE length(word) = 13 AND shard_id <> 0
UNION ALL SELECT DISTINCT shard_id, word, 'repeated contract key' FROM postings WHERE length(word) = 12""",
    "nested_shards": f"WITH {POSTINGS} SELECT shard_id, word, count(*)::INTEGER AS n, min(contract_key) AS first_key, max(tf_idf_score) AS best FROM postings GROUP BY ALL",
    "attestation_union": f"WITH {att()} SELECT * REPLACE (lower(hex(nonce)) AS nonce) FROM att",
    "catalog_merge": f"WITH {att()} SELECT * REPLACE (lower(hex(nonce)) AS nonce) FROM att",
    "stream_attestations": f"WITH {att()} SELECT * REPLACE (lower(hex(nonce)) AS nonce) FROM att",
    "entry_envelope": f"WITH {ENVELOPE} SELECT * FROM envelope",
    "contributor_merge": f"""WITH {att()} SELECT pubkey, max(trust_score)::BIGINT AS trust_score, max(n)::BIGINT AS total_contributions FROM (SELECT lower(hex(pubkey)) AS pubkey, trust_score, total_contributions AS n FROM contributor
UNION ALL SELECT contributor_pubkey, 0, count(*) FROM att GROUP BY 1) GROUP BY 1""",
    "entry_status": f"WITH {att()}, {status()} SELECT contract_key, status, att_count FROM status",
    "contributor_trust": f"WITH {att()}, {status()}, {trust()} SELECT * FROM trust",
    "attestation_weights": f"WITH {att()} SELECT contract_key, metadata_hash, contributor_pubkey, 1 + coalesce(trust_score, 0) AS weight FROM att LEFT JOIN contributor ON contributor_pubkey = lower(hex(pubkey))",
    "variant_weights": f"WITH {att()} SELECT contract_key, metadata_hash, count(*) AS att_count, sum(1 + coalesce(trust_score, 0))::BIGINT AS total_weight FROM att LEFT JOIN contributor ON contributor_pubkey = lower(hex(pubkey)) GROUP BY ALL",
    "best_variant": f"""WITH {att()}, w AS (SELECT contract_key, metadata_hash, sum(1 + coalesce(trust_score, 0))::BIGINT AS total_weight FROM att LEFT JOIN contributor ON contributor_pubkey = lower(hex(pubkey)) GROUP BY ALL)
SELECT contract_key, metadata_hash, total_weight FROM w QUALIFY row_number() OVER (PARTITION BY contract_key ORDER BY total_weight DESC, metadata_hash DESC) = 1""",
    "catalog_finalize": f"WITH {att()}, {final()} SELECT * FROM final",
    "delta_validate": f"WITH {MARKED} SELECT contract_key, metadata_hash, contributor_pubkey, reject_reason, count(*) AS n FROM marked GROUP BY ALL",
    "catalog_validate": f"""WITH {KEYED}, a AS (SELECT DISTINCT contract_key, lower(hex(metadata_hash)) AS metadata_hash, contributor_pubkey, nonce, difficulty, token_created_at, weight FROM catalog_attestation),
s AS (SELECT contract_key, metadata_hash, sum(weight) AS s FROM a GROUP BY ALL),
b AS (SELECT CASE WHEN length(title) % 23 = 1 THEN '' ELSE contract_key END AS contract_key, metadata_hash, title || CASE WHEN length(title) % 19 = 2 THEN '!' ELSE '' END AS title, description, mini_snippet,
  total_weight + CASE WHEN length(title) % 17 = 3 THEN 1 ELSE 0 END AS total_weight FROM keyed)
SELECT contract_key, metadata_hash, 'empty contract key' AS rule FROM b WHERE coalesce(contract_key, '') = ''
UNION ALL SELECT contract_key, metadata_hash, 'wrong hash' FROM b WHERE metadata_hash <> {mhash('title', 'description', 'mini_snippet')}
UNION ALL SELECT DISTINCT contract_key, metadata_hash, 'repeated public key' FROM (SELECT contract_key, metadata_hash FROM a GROUP BY contract_key, metadata_hash, contributor_pubkey HAVING count(*) > 1)
UNION ALL SELECT b.contract_key, b.metadata_hash, 'wrong total weight' FROM b LEFT JOIN s USING (contract_key, metadata_hash) WHERE b.total_weight <> coalesce(s.s, 0)""",
    "new_variants": f"WITH {KEYED} SELECT contract_key, metadata_hash, title FROM keyed WHERE (contract_key, metadata_hash) NOT IN (SELECT (contract_key, lower(hex(metadata_hash))) FROM catalog_attestation WHERE {A_WHERE})",
    "expired_entries": f"""WITH {att()}, {status()}, seen AS (SELECT contract_key, max(epoch_us(received_at) // 1000) AS last_seen FROM catalog_attestation GROUP BY 1)
SELECT contract_key, CASE WHEN last_seen < 1760000000000 - 7776000000 THEN 'Expired' ELSE status END AS status, last_seen FROM status JOIN seen USING (contract_key)""",
    "nested_state": f"WITH {KEYED}, {ENVELOPE} SELECT e.contract_key, e.size_bytes, count(k.metadata_hash)::INTEGER AS variants, min(k.metadata_hash) AS first_hash FROM envelope e LEFT JOIN keyed k USING (contract_key) GROUP BY ALL",
    "bloom_bits": f"WITH {att()} SELECT DISTINCT unnest({bits('(encode(contract_key) || unhex(contributor_pubkey))')}) AS bit FROM att",
    "bloom_contains": f"""WITH b AS (SELECT DISTINCT unnest({bits('encode(contract_key)')}) AS bit FROM catalog_attestation WHERE {B_WHERE}),
a AS (SELECT DISTINCT contract_key FROM catalog_attestation WHERE {A_WHERE}), asked AS (SELECT contract_key, unnest({bits('encode(contract_key)')}) AS bit FROM a)
SELECT contract_key, count(b.bit) = count(*) AS known FROM asked LEFT JOIN b ON asked.bit = b.bit GROUP BY 1""",
    "catalog_summary": f"WITH {att(where=B_WHERE)}, {final()} SELECT DISTINCT unnest({bits('(encode(contract_key) || unhex(best_hash) || ' + be('best_weight', 4) + ')')}) AS bit FROM final",
    "shard_summary": f"""WITH {POSTINGS} SELECT DISTINCT shard_id, unnest({bits("(encode(word) || unhex('FF') || encode(contract_key))")}) AS bit FROM postings
WHERE contract_key IN (SELECT contract_key FROM catalog_attestation WHERE {B_WHERE})""",
    "sync_delta_catalog": f"""WITH {KEYED}, {ENVELOPE}, {att('a', A_WHERE)}, {att('b', B_WHERE)}, {final('fa', 'a')}, {final('fb', 'b')},
peer AS (SELECT DISTINCT unnest({bits('(encode(contract_key) || unhex(best_hash) || ' + be('best_weight', 4) + ')')}) AS bit FROM fb),
asked AS (SELECT contract_key, unnest({bits('(encode(contract_key) || unhex(best_hash) || ' + be('best_weight', 4) + ')')}) AS bit FROM fa),
lacking AS (SELECT contract_key FROM asked LEFT JOIN peer ON asked.bit = peer.bit GROUP BY 1 HAVING count(peer.bit) < count(*))
SELECT a.contract_key, a.metadata_hash, a.contributor_pubkey, k.title, e.size_bytes, e.version, a.token_created_at FROM a JOIN lacking USING (contract_key)
JOIN keyed k ON a.contract_key = k.contract_key AND a.metadata_hash = k.metadata_hash LEFT JOIN envelope e ON e.contract_key = a.contract_key""",
    "sync_delta_shard": f"""WITH {POSTINGS}, item AS (SELECT *, {bits("(encode(word) || unhex('FF') || encode(contract_key))")} AS bits FROM postings),
peer AS (SELECT DISTINCT shard_id, unnest(bits) AS bit FROM item WHERE contract_key IN (SELECT contract_key FROM catalog_attestation WHERE {B_WHERE})),
asked AS (SELECT shard_id, word, contract_key, tf_idf_score, unnest(bits) AS bit FROM item WHERE contract_key IN (SELECT contract_key FROM catalog_attestation WHERE {A_WHERE}))
SELECT a.shard_id, word, contract_key, tf_idf_score, 1::SMALLINT AS difficulty FROM asked a LEFT JOIN peer p ON a.shard_id = p.shard_id AND a.bit = p.bit GROUP BY ALL HAVING count(p.bit) < count(*)""",
    "sync_delta_exact": f"WITH {att('a', A_WHERE)}, {att('b', B_WHERE)} SELECT contract_key, metadata_hash, contributor_pubkey FROM a ANTI JOIN b USING (contract_key, metadata_hash, contributor_pubkey)",
    "search_postings": f"WITH {POSTINGS}, {TERMS}, {MATCHES} SELECT shard_id, word, contract_key, tf_idf_score, times, pos FROM matches",
    "search": f"WITH {SEARCHED} SELECT * FROM best",
    "search_highlight": rf"""WITH {SEARCHED},
marked AS (SELECT *, array_to_string(list_transform(regexp_extract_all(snippet, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda x: CASE WHEN {_plain('lower(x)')} IN ({_WANTED}) THEN '<mark>' || x || '</mark>' ELSE x END), '') AS m FROM best),
placed AS (SELECT *, strlen(m) AS size, strlen(left(m, greatest(instr(m, '<mark>'), 1) - 1)) AS first_at FROM marked),
bounds AS (SELECT *, CASE WHEN first_at <= 150 THEN 0 WHEN first_at + 150 >= size THEN size - 300 ELSE first_at - 150 END AS a, CASE WHEN first_at <= 150 THEN 300 WHEN first_at + 150 >= size THEN size ELSE first_at + 150 END AS b FROM placed),
chars AS (SELECT contract_key, a, b, u.c, u.i, sum(strlen(u.c)) OVER (PARTITION BY contract_key ORDER BY u.i) AS ended FROM bounds, unnest(string_split(m, '')) WITH ORDINALITY AS u(c, i)),
cut AS (SELECT contract_key, string_agg(c, '' ORDER BY i) AS part FROM chars WHERE ended - strlen(c) >= a AND ended <= b GROUP BY 1)
SELECT contract_key, relevance, status, attestation_count, rank, combined_score, title, description,
  CASE WHEN size <= 300 THEN m ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || part || CASE WHEN b < size THEN '...' ELSE '' END END AS highlighted_snippet FROM bounds LEFT JOIN cut USING (contract_key)""",
    "search_all_words": f"""WITH {POSTINGS}, {ENTRIES.replace(VARIANTS + ',', '', 1)}, {TERMS}, {MATCHES},
boosted AS (SELECT contract_key, least(least(sum(tf_idf_score * times), 4294967295) * CASE WHEN count(*) = (SELECT count(*) FROM terms) THEN 2 ELSE 1 END, 4294967295)::BIGINT AS relevance FROM matches GROUP BY 1),
ranked AS (SELECT contract_key, relevance, {rank('coalesce(weighted_att, 0)', 'coalesce(version, 0)', "coalesce(status, 'Pending')")} AS rank FROM boosted LEFT JOIN entries USING (contract_key))
SELECT contract_key, (relevance * 7000 + rank * 3000) // 10000 AS combined_score FROM ranked ORDER BY combined_score DESC, contract_key LIMIT 50""",
    "dedup_by_title": f"""WITH {CACHE}, {att()}, {status()}, apps AS (SELECT c.*, att_count FROM cache c LEFT JOIN status USING (contract_key))
SELECT contract_key, title, size_bytes, version, att_count FROM apps WHERE title IS NULL UNION ALL
SELECT contract_key, title, size_bytes, version, att_count FROM apps WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY {BEST_TITLE}) = 1""",
    "directory_filter": f"WITH {CACHE} SELECT contract_key, title, description FROM cache WHERE coalesce(contains(lower(contract_key), 'maps'), FALSE) OR coalesce(contains(lower(title), 'maps'), FALSE) OR coalesce(contains(lower(description), 'maps'), FALSE)",
    "app_directory": f"""WITH {CACHE}, {TYPES}, {ENTRIES},
known AS (SELECT t.contract_key, c.title, c.description, c.size_bytes, c.version FROM types t LEFT JOIN cache c USING (contract_key) WHERE contract_type = 'WebApp'
  UNION ALL SELECT contract_key, title, description, size_bytes, version FROM cache ANTI JOIN types USING (contract_key)),
apps AS (SELECT k.*, e.description AS cat, e.status, e.att_count FROM known k LEFT JOIN entries e USING (contract_key)),
kept AS (SELECT * FROM apps WHERE title IS NULL UNION ALL (SELECT * FROM apps WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY {BEST_TITLE}) = 1))
SELECT contract_key, title, coalesce(nullif(cat, ''), nullif(description, '')) AS description, status, coalesce(att_count, 0) AS att_count, size_bytes FROM kept ORDER BY title IS NULL, lower(title), contract_key""",
    "discovery_progress": f"""WITH {CACHE}, {TYPES} SELECT count(*) AS contracts, count(*) FILTER (contract_type = 'WebApp') AS web_apps, count(*) FILTER (contract_type = 'WebApp' AND c.contract_key IS NOT NULL) AS titled
FROM types t LEFT JOIN cache c ON t.contract_key = c.contract_key AND c.title IS NOT NULL""",
    "needs_extraction": f"""WITH {CACHE}, seen AS (SELECT DISTINCT app_id, contract_key, title, description, version FROM app_entry)
SELECT s.app_id, s.contract_key, s.version, c.version AS cached_version, s.title IS NULL OR s.description IS NULL OR (s.version IS NOT NULL AND s.version IS DISTINCT FROM c.version) AS needs FROM seen s JOIN cache c USING (contract_key)""",
    "cache_upsert": f"""WITH {CACHE}, {TEXTS}, n AS (SELECT contract_key, nullif(title, '') AS title, nullif(description, '') AS description, length(title) % 2 = 0 AS extracted FROM texts)
SELECT coalesce(n.contract_key, o.contract_key) AS contract_key, CASE WHEN n.contract_key IS NULL THEN o.title WHEN extracted THEN n.title ELSE coalesce(n.title, o.title) END AS title,
CASE WHEN n.contract_key IS NULL THEN o.description WHEN extracted THEN n.description ELSE coalesce(n.description, o.description) END AS description,
CASE WHEN n.contract_key IS NULL THEN o.first_seen ELSE coalesce(o.first_seen, 1) END AS first_seen, CASE WHEN n.contract_key IS NULL THEN o.last_seen ELSE greatest(coalesce(o.last_seen, 1800000000), 1800000000) END AS last_seen,
o.size_bytes, o.subscribers, o.version FROM cache o FULL JOIN n ON o.contract_key = n.contract_key""",
    "contribution_recent": """WITH log AS (SELECT DISTINCT contract_key, epoch_us(received_at) // 1000 AS ts_ms, CASE WHEN nonce IS NULL THEN 'Failed' ELSE 'Submitted' END AS status FROM catalog_attestation),
newest AS (SELECT ts_ms, contract_key FROM log WHERE status = 'Submitted' ORDER BY ts_ms DESC, contract_key DESC LIMIT 1),
acked AS (SELECT l.contract_key, l.ts_ms, CASE WHEN status = 'Submitted' AND n.ts_ms IS NOT NULL THEN 'Confirmed' ELSE status END AS status FROM log l LEFT JOIN newest n ON l.ts_ms = n.ts_ms AND l.contract_key = n.contract_key),
top AS (SELECT *, greatest(1800000000 - ts_ms // 1000, 0) AS s FROM acked ORDER BY ts_ms DESC, contract_key DESC LIMIT 20)
SELECT contract_key, ts_ms, status, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM top""",
    "display_fields": f"""WITH {CACHE} SELECT contract_key, CASE WHEN length(contract_key) <= 16 THEN contract_key ELSE left(contract_key, 8) || '...' || right(contract_key, 8) END AS short_key,
CASE WHEN size_bytes IS NULL THEN NULL WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN (size_bytes // 1024) || ' KB' ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS size,
CASE WHEN first_seen = 0 THEN '—' ELSE strftime(to_timestamp(first_seen), '%b %-d %Y') END AS first_day, subscribers || CASE WHEN subscribers = 1 THEN ' subscriber' ELSE ' subscribers' END AS subscribers FROM cache""",
    "pow_check": """WITH h AS (SELECT DISTINCT nonce, difficulty, sha256(nonce) AS x FROM catalog_attestation), z AS (SELECT *, length(regexp_extract(x, '^0*')) AS n FROM h),
b AS (SELECT *, (CASE WHEN n = 64 THEN 256 ELSE n * 4 + 4 - length(bin(('0x' || substr(x, n + 1, 1))::BIGINT)) END)::INTEGER AS zero_bits FROM z) SELECT lower(hex(nonce)) AS nonce, difficulty, zero_bits, zero_bits >= difficulty AS valid FROM b""",
    "pow_token": """WITH n AS (SELECT i, lpad(lower(hex(i)), 16, '0') AS h FROM range(262144) AS t(i)),
t AS (SELECT i, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS token FROM n)
SELECT i AS nonce, token FROM t WHERE sha256(unhex(token)) LIKE '0000%' ORDER BY i LIMIT 1""",
    "page_metadata": f"""WITH {PAGE_HTML}, e AS (SELECT page_id, contract_key, coalesce(nullif(trim(regexp_replace(trim(regexp_replace(t, '^{WHITE}+|{WHITE}+$', '', 'g')), '<[^>]*>?|>', '', 'g')), ''), '') AS t, d, {VISIBLE} AS v FROM pages),
c AS (SELECT page_id, contract_key, left({norm('t')}, 256) AS title, left({norm('d')}, 1024) AS description, left({norm(cut('v', 2000))}, 2000) AS snippet, left({norm(cut('v', 300))}, 300) AS mini_snippet FROM e)
SELECT *, {mhash('title', 'description', 'snippet')} AS metadata_hash FROM c""",
    "container_latest": f"""WITH p AS (SELECT DISTINCT page_id, contract_key, captured_at, epoch(captured_at)::BIGINT AS version, metadata_hash FROM page_metadata)
SELECT contract_key, version, lower(hex(metadata_hash)) AS state FROM (SELECT *, row_number() OVER (PARTITION BY contract_key ORDER BY version DESC, captured_at < TIMESTAMPTZ '{REPLICA_A_UNTIL} 00:00:00+00' DESC, metadata_hash DESC) AS r
FROM (SELECT * REPLACE (floor(epoch(captured_at))::BIGINT AS version) FROM p) WHERE version > 0) WHERE r = 1""",
    "container_sync": f"""WITH l AS (SELECT contract_key, max(floor(epoch(captured_at))::BIGINT) AS version FROM page_metadata GROUP BY 1),
p AS (SELECT contract_key, max(floor(epoch(captured_at))::BIGINT) AS v FROM page_metadata WHERE captured_at < TIMESTAMPTZ '{REPLICA_B_FROM} 00:00:00+00' GROUP BY 1)
SELECT contract_key, version FROM l LEFT JOIN p USING (contract_key) WHERE v IS NULL OR version > v""",
    "bloom_bytes": f"""WITH {att()}, {final()}, b AS (SELECT DISTINCT unnest({bits('(encode(contract_key) || unhex(best_hash) || ' + be('best_weight', 4) + ')')}) AS bit FROM final),
v AS (SELECT k.i, coalesce(sum(1 << (b.bit % 8)), 0)::BIGINT AS v FROM range(1024) AS k(i) LEFT JOIN b ON b.bit // 8 = k.i GROUP BY 1)
SELECT string_agg(lpad(lower(hex(v)), 2, '0'), '' ORDER BY i) AS bytes FROM v""",
    "page_snippet": f"WITH {PAGE_HTML}, e AS (SELECT page_id, {VISIBLE} AS v FROM pages) SELECT page_id, {cut('v', 2000)} AS snippet FROM e",
    "page_metadata_ui": f"""WITH {PAGE_HTML}, e AS (SELECT page_id, contract_key, nullif(regexp_replace(t, '^{WHITE}+|{WHITE}+$', '', 'g'), '') AS title, nullif(d, '') AS d, {squeezed("regexp_replace(s, '<[^>]*>?|>', '', 'g')")} AS v FROM pages)
SELECT page_id, contract_key, title, coalesce(d, nullif(regexp_replace({cut('v', 200)}, '{WHITE}+$', ''), '')) AS description FROM e""",
    "container_version": "SELECT contract_key, floor(epoch(captured_at))::BIGINT AS version FROM (SELECT DISTINCT page_id, contract_key, captured_at FROM page_metadata)",
    "container_detect": "SELECT w AS whole, w AS container, count(DISTINCT page_id) AS n FROM page_metadata, (VALUES (TRUE), (FALSE)) AS t(w) GROUP BY w",
    "signatures": "SELECT lower(hex(pubkey)) AS pubkey, ('0x' || substr(hex(pubkey), 3, 2))::BIGINT % 2 = 0 AS valid FROM contributor",
    "sync_delta_shard_exact": f"WITH {POSTINGS} SELECT shard_id, word, contract_key, tf_idf_score FROM postings WHERE {IN_A} AND NOT {IN_B}",
    "search_fallback": f"WITH {CACHE} SELECT 'directory' AS shown, contract_key, title FROM cache WHERE coalesce(contains(lower(contract_key), '{PART}'), FALSE) OR coalesce(contains(lower(title), '{PART}'), FALSE) OR coalesce(contains(lower(description), '{PART}'), FALSE)",
    "unknown_keys": f"""WITH {CACHE} SELECT DISTINCT d.contract_key FROM documents d ANTI JOIN (SELECT contract_key FROM cache WHERE first_seen < {KNOWN_UNTIL}) a ON a.contract_key = d.contract_key
ANTI JOIN (SELECT contract_key FROM page_metadata WHERE captured_at < TIMESTAMPTZ '{REPLICA_B_FROM} 00:00:00+00') p ON p.contract_key = d.contract_key WHERE d.contract_key IS NOT NULL""",
    "routed_responses": f"WITH {CACHE} SELECT contract_key, 'app' AS handler FROM cache UNION ALL SELECT 'catalog', 'catalog' UNION ALL SELECT 'shard-' || i, 'shard' FROM range(16) AS t(i)",
    "replayed_keys": f"WITH {CACHE}, {TYPES} SELECT contract_key FROM cache ANTI JOIN (SELECT contract_key FROM types WHERE contract_type = 'WebApp') USING (contract_key)",
    "cache_round_trip": f"WITH {CACHE} SELECT contract_key, title, description, first_seen, last_seen, size_bytes, subscribers, version FROM cache",
    "hex_states": f"WITH {VARIANTS} SELECT variant_id, 32 AS size, metadata_hash AS state FROM variants WHERE variant_id % 5 <> 0",
    "container_signed": "SELECT lower(hex(pubkey)) AS pubkey, ('0x' || substr(hex(pubkey), 1, 2))::BIGINT % 6 < 3 AS valid FROM contributor",
    "state_scan": f"""WITH {KEYED}, {att()}, {ENVELOPE} SELECT a.contract_key, a.metadata_hash, contributor_pubkey, token_created_at, 1 + coalesce(trust_score, 0) AS weight
FROM att a JOIN keyed USING (contract_key, metadata_hash) JOIN envelope USING (contract_key) LEFT JOIN contributor ON contributor_pubkey = lower(hex(pubkey))""",
    "state_envelopes": f"WITH {ENVELOPE} SELECT * FROM envelope WHERE contract_key IS NOT NULL",
    "shard_scan": f"WITH {POSTINGS} SELECT * FROM postings",
    "update_events": f"""WITH {KEYED}, {ENVELOPE}, d AS (SELECT DISTINCT a.contract_key, lower(hex(a.metadata_hash)) AS metadata_hash, lower(hex(contributor_pubkey)) AS contributor_pubkey, nonce, difficulty, token_created_at,
  k.title, k.description, k.mini_snippet AS snippet, e.size_bytes, e.version FROM catalog_attestation a JOIN keyed k ON a.contract_key = k.contract_key AND lower(hex(a.metadata_hash)) = k.metadata_hash
  LEFT JOIN envelope e ON e.contract_key = a.contract_key WHERE nonce IS NOT NULL)
SELECT contract_key, metadata_hash, contributor_pubkey, title, snippet, size_bytes, version, coalesce(difficulty, 0)::SMALLINT AS difficulty, token_created_at FROM d""",
    "shard_events": f"WITH {POSTINGS} SELECT word, contract_key, snippet, tf_idf_score, 1::SMALLINT AS difficulty FROM postings",
    "filter_round_trip": f"WITH {att()} SELECT DISTINCT unnest({bits('(encode(contract_key) || unhex(contributor_pubkey))')}) AS bit FROM att",
    "stream_deltas": f"""WITH {MARKED}, att AS (SELECT contract_key, metadata_hash, contributor_pubkey FROM marked WHERE reject_reason IS NULL GROUP BY ALL), {final()} SELECT * FROM final""",
    "stream_postings": f"WITH {POSTINGS} SELECT * FROM postings WHERE shard_id % 2 = 0 OR length(word) <> 9",
    "search_after_batch": f"""WITH {POSTINGS}, {TERMS}, m AS (SELECT p.*, times, n FROM postings p JOIN terms t ON p.word = t.word, (VALUES (1), (2)) AS b(n) WHERE shard_id % 2 = 0 OR (n = 2 AND length(p.word) <> 9)),
r AS (SELECT n, contract_key, least(sum(tf_idf_score * times), 4294967295)::BIGINT AS relevance FROM m GROUP BY ALL) SELECT count(*) AS keys, sum(relevance)::BIGINT AS relevance FROM r GROUP BY n""",
    "stream_discovered": "SELECT DISTINCT contract_key FROM catalog_attestation",
    "container_extract": f"""WITH pages AS (SELECT DISTINCT page_id, contract_key, floor(epoch(captured_at))::BIGINT AS version, coalesce(title, '') AS t, translate(coalesce(description, ''), '"<>', '') AS d, coalesce(snippet, '') AS s FROM page_metadata),
e AS (SELECT page_id, contract_key, version, regexp_replace(trim(regexp_replace(t, '^{WHITE}+|{WHITE}+$', '', 'g')), '<[^>]*>?|>', '', 'g') AS t, d, {VISIBLE} AS v FROM pages),
c AS (SELECT contract_key, version, left({norm('t')}, 256) AS title, left({norm('d')}, 1024) AS description, left({norm(cut('v', 2000))}, 2000) AS snippet, left({norm(cut('v', 300))}, 300) AS mini_snippet FROM e)
SELECT *, {mhash('title', 'description', 'snippet')} AS metadata_hash FROM c""",
}
