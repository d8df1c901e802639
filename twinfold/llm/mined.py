"""Queries of phrase mining, suffix-array deduplication and importance resampling, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import importance, phrases, suffix_dedup
from twinfold.llm.frames import spread_out, table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spread_out(table(spark, sf_dir, "documents").select("lang", "text")))


ORACLES["op11_phrases"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), cut AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM cut GROUP BY lang
), runs AS (SELECT lang, w[s : s + d - 1] AS ws FROM cut, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS d), LATERAL (SELECT unnest(range(1, len(w) - d + 2)) AS s) WHERE len(w) >= d
), counts AS (SELECT lang, ws, array_to_string(ws, ' ') AS g, count(*)::HUGEINT AS f FROM runs GROUP BY lang, ws HAVING count(*) >= {phrases.LEAST}
), long_ones AS (SELECT * FROM counts WHERE len(ws) > 1
), free AS (SELECT * FROM long_ones c WHERE NOT EXISTS (SELECT 1 FROM long_ones o WHERE o.lang = c.lang AND len(o.ws) > len(c.ws) AND 100 * o.f >= {phrases.COVERED} * c.f AND contains(' ' || o.g || ' ', ' ' || c.g || ' '))
), cuts AS (SELECT lang, g, f AS a, k, array_to_string(ws[1 : k], ' ') AS x, array_to_string(ws[k + 1 :], ' ') AS y FROM free, LATERAL (SELECT unnest(range(1, len(ws))) AS k)
), scored AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, n, 1000 * c.a * n // (x.f * y.f) AS score FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.x JOIN counts y ON y.lang = c.lang AND y.g = c.y JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM lowest)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {phrases.TOP}
"""


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = suffix_dedup.annotate(spread_out(table(spark, sf_dir, "documents").select("doc_id", "text")), "seen")
    return seen.select("doc_id", "seen.n_bytes", "seen.n_removed", "seen.n_spans", F.sha2("seen.kept", 256).alias("kept_sha256"))


ORACLES["op12_suffix_dedup"] = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), places AS (SELECT r, p, md5(b[p : p + {suffix_dedup.LENGTH - 1}]) AS h FROM texts, LATERAL (SELECT unnest(range(1, octet_length(b) - {suffix_dedup.LENGTH - 2})) AS p) WHERE octet_length(b) >= {suffix_dedup.LENGTH}
), twice AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1
), starts AS (SELECT r, p FROM places WHERE h IN (SELECT h FROM twice)
), marked AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS fresh FROM starts
), grouped AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM marked
), runs AS (SELECT r, min(p) AS s, max(p) + {suffix_dedup.LENGTH} AS e FROM grouped GROUP BY r, g
), gaps AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS a, s AS z FROM runs UNION ALL SELECT r, max(e), octet_length(any_value(b)) + 1 FROM runs JOIN texts USING (r) GROUP BY r
), kept AS (SELECT r, unhex(string_agg(CASE WHEN z > a THEN hex(b[a : z - 1]) ELSE '' END, '' ORDER BY a)) AS k FROM gaps JOIN texts USING (r) GROUP BY r
), sums AS (SELECT r, sum(e - s) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(k, b)) AS kept_sha256 FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.weigh(spread_out(docs.select("doc_id", "text")), benchmark).drop("n_words")


_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

ORACLES["op13_importance"] = rf"""
WITH bits AS (SELECT list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS t, b FROM (SELECT unnest(range(256)) AS b)
), crc AS (SELECT list(t::BIGINT ORDER BY b) AS ts FROM bits
), cut AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), mine AS (SELECT r, unnest({_FEATURES}) AS f FROM cut
), theirs AS (SELECT unnest({_FEATURES}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)
), hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM mine UNION SELECT f FROM theirs)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, y: xor(c // 256, ts[xor(c % 256, y) + 1]), 4294967295), 4294967295)::BIGINT % {importance.BUCKETS} AS b
  FROM hexed, crc
), s AS (SELECT b, count(*)::DOUBLE AS n FROM mine JOIN hashed USING (f) GROUP BY b
), t AS (SELECT b, count(*)::DOUBLE AS n FROM theirs JOIN hashed USING (f) GROUP BY b
), sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0) + {importance.BUCKETS} AS s, coalesce((SELECT sum(n) FROM t), 0) + {importance.BUCKETS} AS t
), gains AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * sums.s / ((s.n + 1) * sums.t)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), sums
), weighed AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM mine JOIN hashed USING (f) JOIN gains USING (b) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) >= {importance.LEAST_WORDS} AS fit, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (r)
), placed AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (fit) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
