"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, licenses, manifest, neighbours, ppm, prefixes, rollup, secrets, simhash, toxicity, warc, wrappers
from quire.llm.common import table


def op1_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op8_ppm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op9_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintained(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op12_merkle_postorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proved(table(spark, sf_dir, "documents"))


def op13_prefix_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: the bytes of an ASCII text, bit by bit."""
    steps = f"list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT){', -1' * 8}])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten({steps})), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"


def merkle_sql(levels: int = 5) -> str:
    """Leaves, levels of runs of sixteen, and what stands before and after a node in its run; trees of up to 16**levels leaves and sources."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str) -> str:
        out = ""
        for k in range(levels):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out += f""", {name}p{k} AS (SELECT g, i, c > 1 AS folds, CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS a, CASE WHEN c > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS z FROM {name}{k}),
                {name}{k + 1} AS (SELECT g, i // 16 AS i, any_value((c + 15) // 16) AS c, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE c > 1 GROUP BY g, i // 16 UNION ALL SELECT g, i, c, d FROM {name}{k} WHERE c = 1)"""
        return out

    def folds(name: str, source: str, tag: str) -> str:
        out = f", {tag}0 AS (SELECT *, i AS here FROM {source})"
        for k in range(levels):
            out += f", {tag}{k + 1} AS (SELECT x.* REPLACE (x.here // 16 AS here, CASE WHEN folds THEN sha256(a || x.f || z) ELSE x.f END AS f, x.s || a || z AS s) FROM {tag}{k} x JOIN {name}p{k} p ON p.g = x.g AND p.i = x.here)"
        return out

    return f"""WITH h AS (SELECT doc_id, coalesce('s' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN ({crc32_sql('doc_id::VARCHAR')}) % 5 = 0 THEN {leaf(lowered)} END AS other FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM h),
        t0 AS (SELECT g, i, c, leaf AS d FROM r){tree('t')},
        u0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c, d, g AS source FROM t{levels}){tree('u')},
        docs AS (SELECT r.g, r.i, doc_id, leaf, coalesce(other, leaf) AS f, '' AS s FROM r){folds('t', 'docs', 'x')},
        tops AS (SELECT 'all' AS g, u0.i, u0.d AS subroot, x.doc_id, x.leaf, x.f, x.s FROM x{levels} x JOIN u0 ON u0.source = x.g){folds('u', 'tops', 'y')}
        SELECT doc_id, leaf, subroot, u.d AS root, sha256(y.s) AS proof_sha256, y.f AS folded_root, y.f = u.d AS verified FROM y{levels} y JOIN u{levels} u ON u.g = y.g"""


TRIE_SQL = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own, any_value({crc32_sql('conv_id::VARCHAR')}) % 6 AS h, any_value(conv_id - conv_id % 100) AS base FROM t GROUP BY conv_id),
    p AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path FROM c LEFT JOIN c b ON b.conv_id = c.base),
    m AS (SELECT conv_id, path[1:depth] AS node, depth, len(path) = depth AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM p)),
    n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
    k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth > 0 THEN length(n.node[depth].x) ELSE 0 END AS own FROM n LEFT JOIN k ON k.node = n.node),
    s AS (SELECT node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM x) GROUP BY ALL)
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends_sha256 FROM x JOIN s ON s.node = x.node LEFT JOIN n p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.node = x.node[1:x.depth - 1]"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_subword_softmax, op2_warc_members, op3_license_rules, op4_bm25_wand, op5_secret_layers, op6_bpe_transducer, op7_simhash_pivots, op8_ppm_trie, op9_delta_rollup, op10_block_matrix, op11_wrapper_induction, op12_merkle_postorder, op13_prefix_skeleton)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_block_matrix": """
            WITH v AS (
              SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
        "op12_merkle_postorder": merkle_sql(),
        "op13_prefix_skeleton": TRIE_SQL,
    }
