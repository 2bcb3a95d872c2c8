"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm import bag_minhash, block_search, codebooks, conversations, decontaminate, mixing, packing, piece_counts, quality, records, span_dedup, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_records")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(spark, table(spark, sf_dir, "documents"))


@query("op2_url_filter", """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM u
), r AS (
  SELECT *, translate(host || '#' || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(whole, '(^|[^a-z0-9])anti[^a-z0-9]spam($|[^a-z0-9])') THEN 'allow'
  WHEN regexp_matches(whole, '(^|[^a-z0-9])(ads|adserver|adult|bets|casino|pills|porn|spam|viagra|xxx)($|[^a-z0-9])') THEN 'block'
  WHEN regexp_matches(whole, '(?s)(^|[^a-z0-9])free($|[^a-z0-9])(|.*[^a-z0-9])download($|[^a-z0-9])') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query("op4_bag_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_block_search", """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d
) WHERE rank <= 10
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.search(table(spark, sf_dir, "embeddings"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op7_quality_trees")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_piece_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(table(spark, sf_dir, "documents"), bare_blank=True)


@query("op9_span_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.drop_repeated_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_decontaminate", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
), hit AS (SELECT dw.doc_id, bw.item_id, dw.i, dw.k FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry; the operator's lists and bounds must come to the same."""
    near = "list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT i, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT i, x.p, e, {near} AS d FROM x JOIN b{k} b USING (p)) GROUP BY i, p)")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN (
  SELECT p, e, list(floor(t::DOUBLE / n)::BIGINT ORDER BY j) AS c FROM (
    SELECT x.p, m.e AS e, j, sum(x.c[j]) AS t, count(*) AS n FROM x JOIN a{k} USING (i, p), LATERAL (SELECT unnest(range(1, len(x.c) + 1)) AS j) GROUP BY ALL) GROUP BY p, e) s USING (p, e))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, w) AS i, vec_id, label, w FROM (
    SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)
), x AS (
  SELECT i, p, w[len(w) // 16 * p + 1 : len(w) // 16 * (p + 1)] AS c FROM v, range(16) r(p)
), b0 AS (SELECT p, i - 1 AS e, c FROM x WHERE i <= 64), {', '.join(steps)}, coded AS (
  SELECT vec_id, label, code, error FROM v JOIN (SELECT i, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY i) USING (i)
)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


@query("op11_orchard_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")))


@query("op12_pareto_mix", """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, ' ') || '|' || coalesce(md5(text), ' ')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), f AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    (sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS others FROM s
), l AS (
  SELECT arg_min({'rest': rest, 'others': others}, source_size / weight) AS k FROM f WHERE rest * weight / others <= 3 * source_size
), g AS (
  SELECT source, source_size, CASE WHEN l.k IS NULL OR l.k.rest * weight / l.k.others > 3 * source_size THEN 3 * source_size::DOUBLE ELSE l.k.rest * weight / l.k.others END AS target FROM s, l
), c AS (
  SELECT source, preference, sum(size)::BIGINT AS n FROM (SELECT *, greatest(1, 32 - length(bin(size))) AS preference FROM d WHERE size > 0) GROUP BY ALL
), v AS (
  SELECT c.*, target, source_size, (target - 3.0::DOUBLE * coalesce(sum(n) OVER (PARTITION BY c.source ORDER BY preference DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(preference * n) OVER (PARTITION BY c.source ORDER BY preference DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT source, max(preference) AS top, arg_max(level, preference) AS level FROM v WHERE level * preference <= 3 GROUP BY source
), e AS (
  SELECT v.source, v.preference, n, target, CASE WHEN target >= 3 * source_size OR k.level IS NULL OR v.preference > top THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, k.level * v.preference) END AS copies
  FROM v LEFT JOIN k ON v.source IS NOT DISTINCT FROM k.source
), p AS (
  SELECT source, preference, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p, target - (sum(floor(copies)::BIGINT * n) OVER (PARTITION BY source))::DOUBLE AS open FROM e
), r AS (
  SELECT d.*, whole, p.p, open, u * (1 - p.p) / ((1 - u) * p.p) AS o FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND greatest(1, 32 - length(bin(size))) = p.preference WHERE p.p > 0 AND size > 0
), q AS (
  SELECT *, o / (1 + o) AS v, sum(size) OVER (PARTITION BY source ORDER BY o / (1 + o)) AS upto FROM r
), cut AS (
  SELECT source, min(CASE WHEN upto > open THEN v END) AS stop, min(open) - coalesce(max(CASE WHEN upto <= open THEN upto END), 0)::DOUBLE AS gap FROM q GROUP BY source
), q2 AS (
  SELECT q.source, v, gap, sum(size) OVER (PARTITION BY q.source ORDER BY v) AS upto FROM q JOIN cut ON q.source IS NOT DISTINCT FROM cut.source WHERE v >= stop AND size <= gap
), cut2 AS (
  SELECT source, min(CASE WHEN upto > gap THEN v END) AS stop2, min(gap) - coalesce(max(CASE WHEN upto <= gap THEN upto END), 0)::DOUBLE AS gap2 FROM q2 GROUP BY source
), ends AS (
  SELECT cut.*, stop2, coalesce(gap2, gap) AS gap2 FROM cut LEFT JOIN cut2 ON cut.source IS NOT DISTINCT FROM cut2.source
), later AS (
  SELECT q.source, size, v, gap2 FROM q JOIN ends ON q.source IS NOT DISTINCT FROM ends.source WHERE v >= stop AND NOT (size <= gap AND (stop2 IS NULL OR v < stop2))
), x AS (
  SELECT source, false AS over, arg_min(v, {'n': -size, 'v': v}) AS v FROM later WHERE size <= gap2 GROUP BY source, length(bin(size))
  UNION ALL SELECT source, true, arg_min(v, {'n': size, 'v': v}) FROM later WHERE size > gap2 GROUP BY source
), y AS (
  SELECT x.source, over, x.v, gap2 AS gap, sum(size)::DOUBLE AS n FROM x JOIN later ON later.source IS NOT DISTINCT FROM x.source AND later.v = x.v GROUP BY ALL
), fill AS (
  SELECT source, gap, max(CASE WHEN over THEN {'n': n, 'v': v} END) AS over, list_reduce(
    list_prepend({'n': 0::DOUBLE, 'v': 0::DOUBLE, 'rest': gap, 'picks': []::DOUBLE[]}, coalesce(list({'n': n, 'v': v, 'rest': 0::DOUBLE, 'picks': []::DOUBLE[]} ORDER BY n DESC, v) FILTER (NOT over), [])),
    lambda a, c: CASE WHEN c.n <= a.rest THEN {'n': 0::DOUBLE, 'v': 0::DOUBLE, 'rest': a.rest - c.n, 'picks': list_append(a.picks, c.v)} ELSE a END) AS m FROM y GROUP BY source, gap
), w AS (
  SELECT source, CASE WHEN over.n - gap < m.rest THEN [over.v] ELSE m.picks END AS picks FROM fill
), z AS (
  SELECT d.*, p.whole, p.p, u * (1 - p.p) / ((1 - u) * nullif(p.p, 0)) AS o FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND size > 0 AND greatest(1, 32 - length(bin(size))) = p.preference
), t AS (
  SELECT z.*, source_size, target, coalesce(whole, 0) + CASE WHEN p > 0 AND (stop IS NULL OR o / (1 + o) < stop OR (size <= gap AND (stop2 IS NULL OR o / (1 + o) < stop2)) OR list_contains(picks, o / (1 + o))) THEN 1 ELSE 0 END AS copies
  FROM z LEFT JOIN g ON z.source IS NOT DISTINCT FROM g.source LEFT JOIN ends ON z.source IS NOT DISTINCT FROM ends.source LEFT JOIN w ON z.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::INT AS copies FROM t
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """The same search with whole lists of edits and texts as states, row by row."""
    visible = lambda t: f"rtrim({t}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    step = lambda s, cost, edit, line="[]": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': list_concat({s}.t, {line})}} END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    user, assistant, same = "['user:' || text]", "['assistant:' || text]", "[role || ':' || text]"

    def moved(to: str, letter: str, before: str, named: str) -> str:
        ways = [step(to, 3, "D")]
        for s in before:
            ways += [f"CASE WHEN NOT forced AND {'initial = ' if kind == 'K' else 'initial <> '}'{letter}' THEN {step(s, cost, kind, line)} END" for kind, cost, line in (("K", "late", same), ("R", "late + 2", named))]
        return least(*ways)

    def filled(source: str) -> str:
        users = least("u", *(step(s, 2, "I", "['user:']") for s in ("e", "s", "a")))
        return f"SELECT * REPLACE ({least('a', step('u', 2, 'I', chr(91) + chr(39) + 'assistant:' + chr(39) + chr(93)))} AS a) FROM (SELECT * REPLACE ({users} AS u) FROM ({source}))"

    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    first = f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM (SELECT DISTINCT conv_id FROM f)"
    after = f"""SELECT w.conv_id, w.i + 1 AS i, {step('e', 3, 'D')} AS e, {least(step('s', 3, 'D'), "CASE WHEN NOT forced AND initial = 's' THEN " + step('e', 'late', 'K', same) + ' END')} AS s,
    {moved('u', 'u', 'esa', user)} AS u, {moved('a', 'a', 'u', assistant)} AS a FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1"""
    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda n: ascii(substr(k, n, 1))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, tab
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, {visible('text')} AS v, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered
), f AS (
  SELECT conv_id, turn, role, text, i, initial, prior, v = '' AS blank, v <> '' AND nth > 1 AS again, v <> '' AND nth = 1 AND right(v, 1) NOT IN ('.', '!', '?') AS cut, v = '' OR nth > 1 AS forced,
    CASE WHEN v <> '' AND nth = 1 AND right(v, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late FROM marked
), w AS (
  {filled(first)} UNION ALL {filled(after)}
), ends AS (
  SELECT conv_id, {least('e', 'a')} AS m FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(again::INT) AS again, sum(cut::INT) AS cut, sum((i > 1 AND prior || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM f GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(again, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(array_to_string(m.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query("op13_audit_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))
