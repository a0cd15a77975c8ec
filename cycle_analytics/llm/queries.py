"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from cycle_analytics.llm import (
    line_dedup, mixing, near_dup, packing, periodic_runs, prefix_trie, quality, repeats, token_counts, toxicity,
    url_filters, vector_search, warc,
)
from cycle_analytics.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def over(module: ModuleType, name: str) -> Query:
    """The module's query over one whole table."""
    return lambda spark, root: module.run_query(table(spark, root, name))


QUERIES: dict[str, Query] = {
    "op1_token_counts": over(token_counts, "documents"),
    "op3_warc_records": over(warc, "pages"),
    "op4_exact_top_k": over(vector_search, "embeddings"),
    "op5_url_filters": over(url_filters, "pages"),
    "op8_packing": over(packing, "documents"),
    "op10_quality_rules": over(quality, "documents"),
}

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP3_SQL = f"""
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
        FROM pages
    ), g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}',
            ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)),
            'string_agg', '') AS payload_digest,
        CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> kept THEN kept END AS refers_to
    FROM g
"""

OP4_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
    WITH u AS (
        SELECT page_id,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
        FROM pages
    ), r(verdict, h, p) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ), best AS (
        SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
        FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""

STOP_FORMS = ", ".join(f"'{form}'" for word in quality.STOP_WORDS for form in (word, word.capitalize()))

OP10_SQL = rf"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS x,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
            list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
        FROM documents
    ), g AS (
        SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM t, unnest(range(1, len(ws) - 1)) AS places(i)
    ), c AS (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
    ), r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM c GROUP BY doc_id
    ), m AS (
        SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
            len(list_filter(ws, lambda w: w IN ({STOP_FORMS}))) AS n_stop_words,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM t LEFT JOIN r USING (doc_id)
    ), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines OR n_stop_words < 1) AS kept
    FROM b
"""

ORACLES: dict[str, str] = {
    "op3_warc_records": OP3_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op5_url_filters": OP5_SQL,
    "op10_quality_rules": OP10_SQL,
}

OP2_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
            ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
        FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), c AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * common >= 80 * (x.n + y.n - common)
    ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
    ), r AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
    ), m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM m LEFT JOIN n USING (doc_id)
"""

QUERIES["op2_near_duplicates"] = over(near_dup, "documents")
ORACLES["op2_near_duplicates"] = OP2_SQL

QUERIES["op7_repeated_passages"] = over(repeats, "documents")
QUERIES["op6_mixture"] = over(mixing, "documents")
QUERIES["op9_toxicity"] = lambda spark, root: toxicity.run_query(
    table(spark, root, "documents"), table(spark, root, "labels")
)


# The unsigned checksum of a short text, a bit at a time.
CRC32_SQL = """
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length({0})),
        lambda k: CASE WHEN k % 8 = 0 THEN ord(substr({0}, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)),
        lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1))), 4294967295)
"""

OP11_SQL = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(text, '') AS x,
            md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS step
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, list(step ORDER BY turn NULLS FIRST, step) AS steps,
            list(octet_length(encode(x)) ORDER BY turn NULLS FIRST, step) AS sizes,
            ({CRC32_SQL.format("conv_id::VARCHAR")} % 9)::INT AS h
        FROM t GROUP BY conv_id
    ), r AS (
        SELECT c.conv_id, list_concat(coalesce(a.steps, [])[1:c.h], c.steps[c.h + 1:]) AS steps,
            list_concat(coalesce(a.sizes, [])[1:c.h], c.sizes[c.h + 1:]) AS sizes
        FROM c LEFT JOIN c a ON a.conv_id = c.conv_id - c.conv_id % 5
    ), n AS (
        SELECT array_to_string(steps[1:d], '') AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            any_value(CASE WHEN d = 0 THEN 0 ELSE sizes[d] END) AS size,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(steps) = d), '')) AS ends_sha256
        FROM r, unnest(range(0, len(steps) + 1)) AS depths(d) GROUP BY ALL
    ), k AS (
        SELECT left(node, 32 * (depth::INT - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
    ), u AS (
        SELECT left(n.node, 32 * j::INT) AS node, count(*) FILTER (k.node IS NULL) AS n_leaves,
            sum((n_convs - 1) * size)::BIGINT AS saved_tokens
        FROM n LEFT JOIN k USING (node), unnest(range(0, depth + 1)) AS places(j) GROUP BY ALL
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
        n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN u USING (node) LEFT JOIN k USING (node)
        LEFT JOIN n p ON n.depth > 0 AND p.node = left(n.node, 32 * (n.depth::INT - 1))
"""

OP12_SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
    ), l AS (SELECT r, doc_id, pos, ls[pos] AS line FROM d, unnest(range(1, len(ls) + 1)) AS places(pos)
    ), k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ), f AS (
        SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key
        HAVING count(DISTINCT doc_id) + max(doc_id IS NULL)::INT >= 3
    ), g AS (
        SELECT r, k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone
        FROM k LEFT JOIN f USING (key)
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM g GROUP BY r
"""

QUERIES["op11_prefix_trie"] = over(prefix_trie, "conversations")
ORACLES["op11_prefix_trie"] = OP11_SQL
QUERIES["op12_line_dedup"] = over(line_dedup, "documents")
ORACLES["op12_line_dedup"] = OP12_SQL
QUERIES["op13_periodic_runs"] = over(periodic_runs, "documents")
