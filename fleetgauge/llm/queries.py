"""The operators of this subpackage as queries over whole tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, langid, packing, pieces, pii, quality, radix, repair, simhash, tokens, trie, urls

# Production parameters.
TOKEN_LIMIT = 4096
SEQUENCE = 4096
END_ID = 1
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
             ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs.filter(~langid.held_out())))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, END_ID)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_shared_heads(trie.own_turns(table(spark, sf_dir, "conversations"))))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii, op2_url_filter, op3_token_counts, op4_language_id, op5_quality, op6_packing, op7_byte_bpe, op8_simhash,
           op9_topk_search, op10_exact_dedup, op11_pieces, op12_prefix_trie, op13_repair]
    return {f.__name__: f for f in own}


URL_SQL = """
WITH rules(rhost, rpath, verdict) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS n, page_id,
                 translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT n, rhost || rpath AS rule, verdict,
                row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
         FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.n = fits.n AND place = 1
"""

TOP_SQL = """
WITH fit AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
           FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

COPIES_SQL = """
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g') AS t FROM documents),
groups AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                  row_number() OVER w = 1 AS kept, t
           FROM texts WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM groups
"""


# The CRC-32 of an ASCII string, bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

TRIE_SQL = """
WITH own AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || t)) AS turns
             FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
             GROUP BY conv_id),
heads AS (SELECT conv_id, turns, {crc} % 6 AS h FROM own),
built AS (SELECT heads.conv_id, list_concat(coalesce(base.turns, [])[1:h], heads.turns[h + 1:]) AS turns
          FROM heads LEFT JOIN own base ON base.conv_id = heads.conv_id - heads.conv_id % 100),
prefixes AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns FROM built),
nodes AS (SELECT turns[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 CASE WHEN d > 0 THEN (count(*) - 1) * coalesce(length(turns[1:d][-1].t), 0) ELSE 0 END AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256
          FROM prefixes GROUP BY turns[1:d], d),
children AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node, d)),
spread AS (SELECT unnest(range(d + 1)) AS d, node, saved, n_children FROM counted),
sums AS (SELECT node[1:d] AS node, d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
         FROM spread GROUP BY node[1:d], d)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node, d) LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.node = c.node[1:c.d - 1]
"""

# One step of `walk` takes a row: it is deleted, kept or reroled, and up to two turns are inserted after it. Of all ways to have written a role last, the best stays.
REPAIR_SQL = """
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations WHERE conv_id IS NOT NULL),
hit AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                  coalesce(nullif(left(role, 1), ''), ' ') AS ini FROM hit),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'b'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                          WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 't' ELSE '-' END AS fault,
                  coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
walk(conv_id, i, q, cost, audit, lines) AS (
    SELECT conv_id, 0, q, cost, audit, lines FROM (SELECT DISTINCT conv_id FROM raw),
        (VALUES ('', 0, '', []::VARCHAR[]), ('u', 3, 'I', ['user:']), ('a', 6, 'II', ['user:', 'assistant:'])) t(q, cost, audit, lines)
    UNION ALL
    SELECT conv_id, i, q, cost, audit, lines FROM (
        SELECT conv_id, i, cost + 3 * n AS cost, audit || repeat('I', n) AS audit,
               CASE WHEN n = 0 THEN q WHEN (n = 1) = (q = 'u') THEN 'a' ELSE 'u' END AS q,
               list_concat(lines, CASE WHEN q = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END[1:n]) AS lines
        FROM (SELECT w.conv_id, m.i, w.audit || edit AS audit,
                     w.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END AS cost,
                     CASE edit WHEN 'D' THEN q WHEN 'K' THEN ini WHEN 'R' THEN CASE q WHEN 'u' THEN 'a' ELSE 'u' END END AS q,
                     CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                               ELSE list_append(lines, CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text) END AS lines
              FROM walk w JOIN marked m ON m.conv_id = w.conv_id AND m.i = w.i + 1, (VALUES ('D'), ('K'), ('R')) e(edit)
              WHERE edit = 'D' OR fault IN ('-', 't') AND (edit = 'R' OR ini = CASE q WHEN 'u' THEN 'a' ELSE 'u' END OR ini = 's' AND q = '')),
             (VALUES (0), (1), (2)) t(n))
    QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
           FROM marked GROUP BY conv_id),
best AS (SELECT walk.* FROM walk LEFT JOIN counts USING (conv_id) WHERE i = coalesce(n, 0) AND q IN ('', 'a')
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best LEFT JOIN counts USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(str(r) for r in URL_RULES)
    of_id = CRC.format("CAST(conv_id AS VARCHAR)")
    of_turn = CRC.format("CAST(conv_id AS VARCHAR) || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return {"op2_url_filter": URL_SQL.format(rules=rules), "op9_topk_search": TOP_SQL, "op10_exact_dedup": COPIES_SQL,
            "op12_prefix_trie": TRIE_SQL.format(crc=of_id), "op13_repair": REPAIR_SQL.format(crc=of_turn)}
