"""The operators applied to their whole tables with production parameters, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketry.llm import bpe, fingerprint, language_id, license_scan, near_dedup, ngram_scores, packing, prefix_trie, quality_rules, ranked_search, secret_scan, sharding, url_filter
from basketry.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return keep


@register("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op4_byte_pair_encoding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


_OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) > 4 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))
                                                                 WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a),
j AS (SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, doc_id = component_id AS kept FROM j
"""


@register("op8_minhash_near_dedup", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op10_retrieval_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, p, list_slice(ws, p, p + 4) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, i, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS before, ls[i + 1] AS after FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM w)),
m AS (SELECT doc_id, i, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
             length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS syms,
             len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) <= 12 AS few,
             length(line) <= 40 AS small, regexp_matches(line, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$') AS ends,
             coalesce(regexp_matches(after, '^[\x20\x09-\x0D]*\p{Ll}'), false) OR (regexp_matches(line, '^[\x20\x09-\x0D]*\p{Ll}') AND coalesce(NOT regexp_matches(before, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$'), false)) AS runs_on,
             regexp_matches(line, '(\||»|›|•|·|→)|\x20>\x20') AS menu,
             regexp_matches(lower(line), '\b(cookie policy|cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript|javascript is|sign up|log ?in|sign in|subscribe|newsletter|share (this|on)|follow us|read more|click here|powered by|skip to content|impressum|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|jetzt anmelden|folgen sie uns|weiterlesen|mentions légales|tous droits réservés|se connecter|inscrivez-vous|abonnez-vous|suivez-nous|lire la suite|aviso legal|todos los derechos reservados|iniciar sesión|suscríbete|síguenos|leer más)\b') AS furniture
      FROM lines),
good AS (SELECT doc_id, count(*) AS n_good, sum(chars) AS chars_left FROM m
         WHERE NOT (10 * syms >= chars OR (menu AND NOT ends) OR (few AND (small AND NOT ends AND NOT runs_on OR furniture))) GROUP BY doc_id),
j AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) - coalesce(n_good, 0) AS BIGINT) AS lines_removed, CAST(coalesce(chars_left, 0) AS BIGINT) AS chars_left
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN good USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND 100 * chars_left >= 50 * word_chars AS kept FROM b
"""


@register("op7_quality_rules", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@register("op6_kd_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


_OP1_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'gs') AS shown, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
                  regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's') AS query FROM pages),
q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&') AS asked FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '')
                     || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS canonical_url FROM q),
rules AS (SELECT * FROM (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
                                ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')) AS v(says, rule, of_host, of_path)),
hits AS (SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM k JOIN rules
         ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path) GROUP BY page_id, url),
m AS (SELECT canonical_url, host, length(regexp_replace(shown, '[\x20\x09-\x0D]', '', 'g')) AS chars, length(shown) - length(regexp_replace(shown, '[#*$%]', '', 'g')) AS marks FROM k),
listed AS (SELECT DISTINCT canonical_url FROM m WHERE (chars > 0 AND 10 * marks >= chars) OR list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']))
SELECT k.page_id, host, path, h.rule, coalesce(h.says, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, k.canonical_url,
       h.rule IS NULL AND l.canonical_url IS NOT NULL AS listed
FROM k LEFT JOIN hits h ON k.page_id = h.page_id AND k.url = h.url LEFT JOIN listed l ON k.canonical_url = l.canonical_url
"""


@register("op1_url_filter", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), url_filter.reported(pages.select("url", "html")))


@register("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = secret_scan.common_pieces(public_tokenizers.path("word_bpe_49k.json"))
    return secret_scan.scan(table(spark, sf_dir, "documents"), pieces)


_OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS cell,
                  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(cell ORDER BY turn NULLS FIRST, cell) AS cells FROM t GROUP BY conv_id),
w AS (SELECT DISTINCT cell, words FROM t),
bits AS (SELECT i FROM range(0, 256) AS r(i)),
step AS (SELECT i, i AS c, 0 AS k FROM bits UNION ALL
         SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS table_of FROM step WHERE k = 8),
h AS (SELECT conv_id, cells, conv_id - conv_id % 20 AS base,
             CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                      lambda acc, b: xor(acc >> 8, table_of[CAST(xor(acc, b) & 255 AS INTEGER) + 1])), 4294967295) % 4 AS INTEGER) AS h FROM own, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.cells, 1, h), []), list_slice(h.cells, h + 1, len(h.cells))) AS path FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, md5(array_to_string(list_slice(path, 1, d), '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_slice(path, 1, d - 1), '')) END AS parent,
             CASE WHEN d > 0 THEN path[d] END AS cell, d = len(path) AS last FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(cell) AS cell, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS saved FROM n LEFT JOIN k USING (node) LEFT JOIN w USING (cell)),
up AS (SELECT node, node AS top FROM n UNION ALL SELECT up.node, n.parent FROM up JOIN n ON n.node = up.top WHERE n.parent IS NOT NULL),
s AS (SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up JOIN v ON v.node = up.node GROUP BY top)
SELECT v.conv_id, depth, q.conv_id AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM (SELECT node, parent, depth, conv_id, n_convs, n_children, ends_sha256 FROM v) v JOIN s ON s.top = v.node LEFT JOIN (SELECT node, conv_id FROM n) q ON q.node = v.parent
"""


@register("op11_prefix_trie", _OP11_SQL.replace("WITH t", "WITH RECURSIVE t", 1))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.branched_paths(table(spark, sf_dir, "conversations")))


@register("op12_katz_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.score(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
i AS (SELECT DISTINCT item_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
m AS (SELECT row, doc_id, 10 + (90 * len(terms) * n) // l AS m, terms FROM d, g WHERE len(terms) > 0),
f AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), g),
s AS (SELECT item_id, m.row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, m.row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@register("op13_ranked_search", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
