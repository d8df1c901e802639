"""The queries of the subpackage by name, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, licenses, line_dedup, mined, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, url_filter
from twinfold.llm.frames import spread_out, table

QUERIES, ORACLES = dict(mined.QUERIES), dict(mined.ORACLES)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(spread_out(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLES["op1_near_dedup"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(len(w), 4) - 1], ' ') AS g
  FROM cut, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 80 * (a.n + b.n - s.n)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x
), roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy_no", "mix_key")


ORACLES["op2_mixing"] = f"""
WITH sources AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS bytes FROM documents GROUP BY source
), sums AS (SELECT sum(bytes) AS total, sum(pow(bytes, {mixing.TEMPERATURE})) AS weighed FROM sources
), rated AS (SELECT source, pow(bytes, {mixing.TEMPERATURE}) / weighed * total / bytes AS rate FROM sources, sums WHERE bytes > 0
), terms AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT)) AS j FROM rated
), cdf AS (SELECT source, sum(exp(j * ln(rate) - rate - lgamma(j + 1.0))) OVER (PARTITION BY source ORDER BY j) AS c FROM terms
), drawn AS (SELECT d.*, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d
), counted AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n FROM drawn d
), copies AS (SELECT *, unnest(range(1, n + 1)) AS k FROM counted)
SELECT doc_id, source, lang, n_chars, text, k::INT AS copy_no, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || k || ':' || md5(coalesce(text, ''))) AS mix_key FROM copies
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # the texts end here: what is written beside the statistics is the id
    seen = quality_rules.judge(docs, "seen", keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return seen.select("doc_id", *[F.col("seen.statistics")[k].alias(k) for k in names], "seen.base_failed", "seen.kept", F.round("seen.posterior", 6).alias("posterior"))


def _rounds_of_em() -> str:
    """SQL of the vote patterns with their posteriors, one recursion a round."""
    names, q = _RULES, quality_rules
    sums, odds = [], []
    for v in names:
        at = lambda value, weight, v=v: f"coalesce(sum(CASE WHEN {v} = {value} THEN c * {weight} END) OVER (), 0) / sum(c) OVER ()"
        sums += [f"{at(-1, 'p')} + {q.RARE} AS gn_{v}", f"{at(1, 'p')} + {q.FAITH} AS gp_{v}", f"{at(-1, '(1 - p)')} + {q.RARE} AS bn_{v}", f"{at(1, '(1 - p)')} + {q.RARE} AS bp_{v}"]
        g, b = f"gn_{v} / (gn_{v} + gp_{v})", f"bn_{v} / (bn_{v} + bp_{v})"
        odds.append(f"CASE WHEN {v} = 0 OR NOT {g} < {b} THEN 0 WHEN {v} = -1 THEN ln({g} / ({b})) ELSE ln((1 - {g}) / (1 - {b})) END")
    share = f"least(greatest((sum(c * p) OVER () / sum(c) OVER () + {q.FAITH * q.GOOD}) / {1 + q.FAITH}, {q.SHARE[0]}), {q.SHARE[1]}) AS share"
    listed = ", ".join(names)
    return f"""em AS (
  SELECT 0 AS k, {listed}, count(*)::DOUBLE AS c, CASE WHEN -1 IN ({listed}) THEN 0.05::DOUBLE ELSE 0.95::DOUBLE END AS p FROM ballots GROUP BY ALL
  UNION ALL
  SELECT k + 1, {listed}, c, 1 / (1 + exp(-(ln(share / (1 - share)) + {" + ".join(odds)}))) FROM (SELECT *, {share}, {", ".join(sums)} FROM em WHERE k < {q.ROUNDS})
)"""


_RULES = ("symbols", "marks", "capitals", "shouts", "repeated_words", "repeated_lines", "distinct_words", "word_length")

ORACLES["op3_quality_rules"] = rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts
), runs AS (SELECT r, s, array_to_string(w[s : s + 4], ' ') AS g FROM cut, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS s) WHERE len(w) >= 5
), often AS (SELECT r, s FROM runs QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + 5)) AS i FROM often) GROUP BY r
), stats AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(t, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts
  FROM cut LEFT JOIN covered USING (r)
), shares AS (
  SELECT *, greatest(n_words, 1)::DOUBLE AS n, 1 - n_distinct / greatest(n_words, 1)::DOUBLE * sqrt(greatest(n_words, {quality_rules.LONG_TEXT}) / {quality_rules.LONG_TEXT}::DOUBLE) AS few, word_chars / greatest(n_words, 1)::DOUBLE AS wide FROM stats
), ballots AS (
  SELECT r, CASE WHEN n_words = 0 THEN 0 WHEN n_symbols / n <= 0.05 THEN 1 WHEN n_symbols / n >= 0.2 THEN -1 ELSE 0 END AS symbols,
    CASE WHEN n_words < 20 THEN 0 WHEN n_marks / n <= 0.3 THEN 1 WHEN n_marks / n >= 0.45 THEN -1 ELSE 0 END AS marks,
    CASE WHEN n_words = 0 THEN 0 WHEN n_capitals / greatest(word_chars, 1)::DOUBLE <= 0.15 THEN 1 WHEN n_capitals / greatest(word_chars, 1)::DOUBLE >= 0.4 THEN -1 ELSE 0 END AS capitals,
    CASE WHEN n_words = 0 THEN 0 WHEN n_shouts / n <= 0.1 THEN 1 WHEN n_shouts / n >= 0.5 THEN -1 ELSE 0 END AS shouts,
    CASE WHEN n_words = 0 THEN 0 WHEN n_repeat_words / n <= 0.1 THEN 1 WHEN n_repeat_words / n >= 0.3 THEN -1 ELSE 0 END AS repeated_words,
    CASE WHEN n_lines < 3 OR n_words = 0 THEN 0 WHEN n_dup_lines / n_lines::DOUBLE <= 0.2 THEN 1 WHEN n_dup_lines / n_lines::DOUBLE >= 0.5 THEN -1 ELSE 0 END AS repeated_lines,
    CASE WHEN n_words < 20 THEN 0 WHEN few <= 0.5 THEN 1 WHEN few >= 0.75 THEN -1 ELSE 0 END AS distinct_words,
    CASE WHEN n_words = 0 THEN 0 WHEN wide >= 2.5 AND wide <= 10 THEN 1 WHEN wide < 1.5 OR wide > 20 THEN -1 ELSE 0 END AS word_length
  FROM shares
), {_rounds_of_em()}, judged AS (SELECT r, p FROM ballots JOIN em USING ({", ".join(_RULES)}) WHERE k = {quality_rules.ROUNDS}
), failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior FROM failed JOIN judged USING (r)
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    slim = docs.select("doc_id", sharding.size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), sharding.key_of(text, F.col("doc_id")).alias("text_key"))
    dealt = sharding.shard(slim, key=F.col("text_key"), size=F.col("size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op4_sharding"] = f"""
WITH bits AS (SELECT list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS t, b FROM (SELECT unnest(range(256)) AS b)
), crc AS (SELECT list(t::BIGINT ORDER BY b) AS ts FROM bits
), sized AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS h FROM documents
), placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) AS r, sum(size) OVER () AS total FROM sized
), dealt AS (SELECT *, least({sharding.SHARDS} * b // total, {sharding.SHARDS - 1})::INT AS shard FROM placed
), hexed AS (SELECT *, hex(encode(coalesce(text, ''))) AS x FROM dealt)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, y: xor(c // 256, ts[xor(c % 256, y) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INT AS grown_shard
FROM hexed, crc
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), report="seen")
    return left.select("doc_id", "source", "seen.*", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op5_line_dedup"] = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), cut AS (
  SELECT r, source, i, l, regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM numbered)
), counting AS (SELECT * FROM cut WHERE regexp_matches(bare, '([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+){{{line_dedup.LEAST_WORDS - 1}}}[^\\x20\\x09-\\x0D]')
), gone AS (SELECT bare FROM counting GROUP BY bare HAVING count(DISTINCT source) >= {line_dedup.LEAST_SITES}
), marked AS (SELECT c.*, bare IN (SELECT bare FROM gone) AND (r, i) IN (SELECT (r, i) FROM counting) AS drop_it FROM cut c
), joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT drop_it), '') AS t FROM marked GROUP BY r)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN md5(t) END AS text_md5 FROM numbered LEFT JOIN joined USING (r)
"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    seen = decontaminate.annotate(docs.select("doc_id", "text"), items, "seen")
    return seen.select("doc_id", "seen.*", decontaminate.is_contaminated(F.col("seen")).alias("contaminated"))


ORACLES["op6_decontaminate"] = r"""
WITH cut AS (
  SELECT rowid AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM wins
), places AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM cut, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n
), found AS (SELECT r, s, p.n, item_id FROM places p JOIN wins USING (win)
), words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM found) GROUP BY r
), owners AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM cut LEFT JOIN words USING (r) LEFT JOIN owners USING (r)
"""


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # a page's outcome is its label: good quality and not toxic; unknown where the labels do not decide it
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    outcomes = pages.join(good, pages["page_id"] == good["doc_id"]).select("url", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return url_filter.judge(pages.select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _rule_rows() -> str:
    return ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)


def _level(name: str, source: str, by: str, prior: str) -> str:
    """SQL of one level: its prior weight by moments, then posterior means."""
    low, high = url_filter.PRIOR_WEIGHT
    return f"""{name}_r AS (SELECT sum(n / ({prior} * (1 - {prior})) * pow(good / n - {prior}, 2) - 1) / nullif(sum(n - 1), 0) AS r FROM {source} WHERE n > 0 AND {prior} > 0 AND {prior} < 1
), {name} AS (SELECT {by}, n, good, k, (good + k * {prior}) / (n + k) AS mean FROM {source}, (SELECT CASE WHEN r > 0 THEN least(greatest(1 / r - 1, {low}), {high}) ELSE {high} END AS k FROM {name}_r))"""


ORACLES["op7_url_filter"] = f"""
WITH parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), own AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '(.)\\.$', '\\1') AS whose FROM parts
), labelled AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id
), outcomes AS (SELECT whose AS host, (q = 1 AND t = 0)::INT AS good FROM own JOIN labelled ON page_id = doc_id WHERE whose <> ''
), seen AS (SELECT DISTINCT whose AS host, coalesce(regexp_extract(whose, '(?:^|\\.)({"|".join(s.replace(".", "\\.") for s in sorted(url_filter.SUFFIXES, key=len, reverse=True))})$', 1), '') AS known FROM own WHERE whose <> ''
), suffixed AS (SELECT *, CASE WHEN regexp_matches(host, '^([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+|\\[.*\\])$') THEN host WHEN known <> '' THEN known ELSE regexp_extract(host, '[^.]*$') END AS suffix FROM seen
), named AS (SELECT *, CASE WHEN host = suffix THEN host ELSE regexp_extract(substr(host, 1, length(host) - length(suffix) - 1), '[^.]*$') || '.' || suffix END AS domain FROM suffixed
), counts AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM outcomes WHERE good IS NOT NULL GROUP BY host
), domained AS (SELECT * FROM named JOIN counts USING (host)
), overall AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS p FROM domained
), s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(p) AS p FROM domained, overall GROUP BY suffix
), {_level("s1", "s0", "suffix", "p")}
, d0 AS (SELECT suffix, domain, sum(d.n) AS n, sum(d.good) AS good, any_value(mean) AS p FROM domained d JOIN s1 USING (suffix) GROUP BY suffix, domain
), {_level("d1", "d0", "domain", "p")}
, h0 AS (SELECT host, h.n, h.good, d1.mean AS p FROM domained h JOIN d1 USING (domain)
), {_level("h1", "h0", "host", "p")}
, ws AS (SELECT (SELECT k FROM s1 LIMIT 1) AS ks, (SELECT k FROM d1 LIMIT 1) AS kd, (SELECT k FROM h1 LIMIT 1) AS kh, p FROM overall
), bare AS (
  SELECT host, coalesce(d1.mean, s1.mean, p) AS m,
    1 - (1 - 1 / (kh + 1)) * CASE WHEN d1.mean IS NULL THEN 1 - 1 / (kd + 1) ELSE 1 END * CASE WHEN d1.mean IS NULL AND s1.mean IS NULL THEN 1 - 1 / (ks + 1) ELSE 1 END AS part
  FROM named x CROSS JOIN ws LEFT JOIN d1 ON d1.domain = x.domain LEFT JOIN s1 ON s1.suffix = x.suffix WHERE x.host NOT IN (SELECT host FROM counts)
), uppers AS (
  SELECT host, mean + {url_filter.DEVIATIONS} * sqrt(mean * (1 - mean) / (n + k + 1)) AS upper FROM h1
  UNION ALL SELECT host, m + {url_filter.DEVIATIONS} * sqrt(m * (1 - m) * part) FROM bare
), blocked AS (SELECT host FROM uppers WHERE upper < {url_filter.LEAST}
), rules(v, rule, name, start) AS (VALUES {_rule_rows()}
), fits AS (SELECT page_id, url, max_by(v, length(rule)) AS v, max_by(rule, length(rule)) AS rule FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id, url
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN whose IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM own LEFT JOIN fits USING (page_id, url)
"""


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    counts = [F.col(f"found.n_{k}") for k in pii.KINDS]
    n_private = sum((F.col(f"found.n_{k}") for k in pii.KINDS if k != "url"), F.lit(0).cast("long"))
    return found.select("doc_id", *counts, "found.base_sha256", "found.spans", n_private.alias("n_private"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, "score")
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_classifier.LEAST_SCORE).cast("int").alias("predicted"))


def _path() -> Column:
    """Documents have no paths; this lays them out by source, language and id, a few of them higher up."""
    name, deep = F.format_string("%d.txt", "doc_id"), F.pmod("doc_id", F.lit(8))
    return F.when(deep == 0, F.concat_ws("/", "source", name)).when(deep <= 2, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", F.pmod("doc_id", F.lit(61)).cast("string"), name))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread_out(table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), "text"))
    return licenses.scan(files).select("doc_id", "path", "license", "cosine", "found_in")
