"""Registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, collocations, exact_dedup, language, mixing, near_dedup, nearest, periodic_runs, pipeline, secret_scan, sharding, substring_dedup, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), ngram=4, percent=80)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    network = language.train(docs, ~held_out)
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), network)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["lang", "source", "size"]
    rows = sharding.document_metadata(_table(spark, sf_dir, "documents"), dims[:2])
    placed = sharding.hilbert_shards(rows, dims, 40, ["doc_id", *dims], together="text_sha256")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


#: Rules given as host and path of a URL, each for the host and its subdomains.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, [(name, f"||{name}", verdict) for name, verdict in HOST_RULES])
    fallback = url_filter.rule_table(spark, [(p, p, "block") for p in url_filter.DEFAULT_BLOCKS])
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules, fallback)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents"))
    return periodic_runs.digested(periodic_runs.find_runs(planted))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.listed(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_exact_dedup, op3_language, op4_sharding, op5_url_filter, op6_nearest, op7_substring_dedup, op8_bpe, op9_mixing, op10_token_counts, op11_periodic_runs, op12_secret_scan, op13_collocations)} | {"pipeline": pipeline.run}

OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

_HOST_PATH = """SELECT page_id,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages"""

OP5_SQL = f"""
WITH p AS ({_HOST_PATH}),
r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT DISTINCT host, path, rule, verdict FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY ALL),
w(pattern, re) AS (VALUES ('||spam-*/', '^([^/]*\\.)?spam-[\\s\\S]*/'), ('||cheap-*/', '^([^/]*\\.)?cheap-[\\s\\S]*/'),
  ('*/wp-login.php*', '^[\\s\\S]*/wp-login\\.php'), ('*/cgi-bin/*', '^[\\s\\S]*/cgi-bin/'), ('*.exe', '\\.exe$'), ('*.zip', '\\.zip$')),
other AS (SELECT host, path, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern
  FROM (SELECT DISTINCT host, path FROM p) JOIN w ON regexp_matches(host || path, re) GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN best.rule IS NULL THEN pattern END AS fallback_rule
FROM p LEFT JOIN best USING (host, path) LEFT JOIN other USING (host, path)
"""

OP6_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
lv AS (SELECT a.source, (1.5 * (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(2.0 * b.source_size) FROM w b WHERE 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0))
    / (SELECT sum(b.weight) FROM w b WHERE 2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight) AS level, 2.0 * a.source_size / a.weight AS full_at FROM w a),
t AS (SELECT source, source_size, least(2.0 * source_size, coalesce((SELECT arg_min(level, full_at) FROM lv WHERE level <= full_at) * weight, 2.0 * source_size))::DOUBLE AS target FROM w),
r AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM t),
x AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS lot FROM d),
k AS (SELECT r.source, turn, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN lot + turn / 32.0::DOUBLE - floor(lot + turn / 32.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source, range(32) AS t(turn) GROUP BY r.source, turn),
b AS (SELECT source, first(turn ORDER BY miss, turn) AS turn FROM k GROUP BY source)
SELECT doc_id, size, r.source_size, r.target,
  ((floor(rate) + CASE WHEN lot + turn / 32.0::DOUBLE - floor(lot + turn / 32.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x JOIN r ON x.source IS NOT DISTINCT FROM r.source JOIN b ON x.source IS NOT DISTINCT FROM b.source
"""

#: All pairs that share a shingle, over the distinct word sequences.
OP1_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT min(doc_id) AS node, list(doc_id) AS ids, w FROM d WHERE len(w) > 0 GROUP BY w),
s AS MATERIALIZED (SELECT node, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: hash(array_to_string(w[i:i+3], ' '))))) AS h FROM t),
n AS MATERIALIZED (SELECT node, count(*) AS n FROM s GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.node < y.node GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node AS a, node AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
f AS (SELECT unnest(ids) AS doc_id, n.n, component FROM t JOIN n USING (node) JOIN c USING (node))
SELECT doc_id, coalesce(f.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM d LEFT JOIN f USING (doc_id)
"""

OP7_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13),
s AS MATERIALIZED (SELECT doc_id, pos, md5(array_to_string(w[pos:pos+12], ' ')) AS h FROM i),
m AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM s JOIN m USING (h), range(13) AS o(k) WHERE least < doc_id),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
y AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM v ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

OP13_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
e AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) AS t(k) WHERE len(w) >= k),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS f FROM e GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
v AS MATERIALIZED (SELECT lang, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j+1:], ' ') AS rest FROM c JOIN range(1, 4) AS t(j) ON j < k),
y AS MATERIALIZED (SELECT v.*, g.f AS l FROM v JOIN g ON g.lang = v.lang AND g.phrase = v.head),
u AS MATERIALIZED (SELECT y.lang, y.phrase, y.f AS a, j, l, g.f AS r, ((2000000::HUGEINT * y.f) // (l + g.f))::BIGINT AS score FROM y JOIN g ON g.lang = y.lang AND g.phrase = y.rest),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (SELECT lang, array_to_string(w[i:i+m-1], ' ') AS phrase, max(f) AS most FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM c JOIN range(2, 4) AS t(m) ON m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM b LEFT JOIN s USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000
"""

_ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_KINDS = ((0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24), (3, "random", secret_scan.TOKEN, 0, 20))


def _tail(z: str) -> str:
    """Probability beyond |z| on both sides, as the operator approximates it."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    terms = "+".join(f"({a})::DOUBLE * pow({t}, {i})" for i, a in enumerate((0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 1))
    return f"(({terms}) * exp(-({z}) * ({z}) / 2))"


_MATCHED = " UNION ALL ".join(
    f"SELECT r, {k} AS kind, {least} AS least, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}', 0)) AS whole, unnest(regexp_extract_all(t, '{p}', {g})) AS val FROM d"
    for k, _, p, g, least in _KINDS
)
_SHOWN = " ".join(
    f"WHEN regexp_full_match(body, '[{chars}]+') AND {' AND '.join(f"regexp_matches(body, '[{c}]')" for c in needs)} THEN {{'name': '{name}', 'alphabet': '{alphabet}'}}"
    for (name, alphabet, _), (chars, needs) in zip(secret_scan.ENCODINGS, (("0-9a-f", ("0-9", "a-f")), ("0-9A-F", ("0-9", "A-F")), ("A-Z2-7", ("2-7", "A-Z")), ("0-9a-z", ("0-9", "a-z")), ("0-9A-Z", ("0-9", "A-Z")), ("0-9A-Za-z", ("0-9", "a-z", "A-Z")), ("A-Za-z0-9+/", ("0-9", "a-z", "A-Z")), ("A-Za-z0-9_-", ("0-9", "a-z", "A-Z"))), strict=True)
)
_GRID = range(secret_scan.STEPS)

OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED (SELECT * FROM ({_MATCHED}) WHERE whole IS NOT NULL),
s AS MATERIALIZED (SELECT r, kind, whole, sum(length(gap) + length(whole)) OVER (PARTITION BY r, kind ORDER BY i) AS stop, stop - length(whole) AS start, length(val) >= least AS ok FROM m),
b AS MATERIALIZED (SELECT r, kind, start, stop FROM s WHERE ok AND kind < 3),
o AS MATERIALIZED (SELECT row_number() OVER () AS id, r, start, stop, rtrim(whole, '=') AS body, CASE {_SHOWN} END AS e FROM s
  WHERE kind = 3 AND NOT EXISTS (FROM b WHERE b.r = s.r AND b.start < s.stop AND b.stop > s.start)),
c AS (SELECT id, length(e.alphabet)::DOUBLE AS k, i, strpos(e.alphabet, ch) - 1.0::DOUBLE AS x FROM (SELECT id, e, unnest(string_split(body, '')) AS ch, unnest(range(1, length(body) + 1)) AS i FROM o WHERE e IS NOT NULL)),
w AS MATERIALIZED (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY i) AS y, avg(x) OVER (PARTITION BY id) AS mean FROM c),
q AS (SELECT id, sum(n * n) AS squares FROM (SELECT id, x, count(*) AS n FROM w GROUP BY ALL) GROUP BY id),
g AS (SELECT id, any_value(k) AS k, count(*)::DOUBLE AS n, count(*) FILTER (WHERE x < floor(k / 2))::DOUBLE AS low, 1.0 + count(*) FILTER (WHERE (x < floor(k / 2)) <> (y < floor(k / 2))) AS stretches,
  sum((x - mean) * (y - mean)) FILTER (WHERE i % {secret_scan.BLOCK} <> 0) AS joint, sum((x - mean) * (x - mean)) AS variation FROM w GROUP BY id),
z AS (SELECT id, n, (pow(greatest(k / n * squares - n, 0) / (k - 1), 1 / 3.0::DOUBLE) - 1 + 2 / (9 * (k - 1))) / sqrt(2 / (9 * (k - 1))) AS chi,
  CASE WHEN 2 * low * (n - low) > n THEN (stretches - 2 * low * (n - low) / n - 1) / sqrt(2 * low * (n - low) * (2 * low * (n - low) - n) / (n * n * (n - 1))) END AS runs,
  CASE WHEN variation > 0 THEN (joint / variation + 1 / n) * sqrt(n) END AS serial FROM g JOIN q USING (id)),
p AS MATERIALIZED (SELECT id, o.r, start, stop, e.name AS encoding, floor(2 * log2(greatest(n, {secret_scan.LEAST}) / {secret_scan.LEAST}))::INTEGER AS band,
  1 - pow(1 - least(CASE WHEN chi > 0 THEN {_tail('chi')} / 2 ELSE 1 - {_tail('chi')} / 2 END, coalesce({_tail('runs')}, 0), coalesce({_tail('serial')}, 0)), 3) AS p FROM z JOIN o USING (id)),
a AS (SELECT encoding, band, {', '.join(f'count(*) FILTER (WHERE p >= {k / secret_scan.STEPS}::DOUBLE) AS a{k}' for k in _GRID)} FROM p GROUP BY ALL),
h AS (SELECT *, least({', '.join(f'(a{k} + sqrt(a{k}) + 1) / (1 - {k / secret_scan.STEPS}::DOUBLE)' for k in range(secret_scan.STEPS // 2 + 1))}) AS rnd FROM a),
l AS (SELECT encoding, band, coalesce({', '.join(f'CASE WHEN a{k} > 0 AND rnd * (1 - {k / secret_scan.STEPS}::DOUBLE) >= {1 - secret_scan.SHARE}::DOUBLE * a{k} THEN {k / secret_scan.STEPS}::DOUBLE END' for k in _GRID if k)}) AS threshold FROM h),
f AS (SELECT * FROM b UNION ALL SELECT r, 3, start, stop FROM p JOIN l USING (encoding, band) WHERE p >= threshold),
n AS (SELECT r, kind, start, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS span FROM f),
x AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM n GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (r)
"""

ORACLE_SQL = {"op12_secret_scan": OP12_SQL, "op13_collocations": OP13_SQL, "op1_near_dedup": OP1_SQL, "op7_substring_dedup": OP7_SQL, "op2_exact_dedup": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_nearest": OP6_SQL, "op9_mixing": OP9_SQL}
