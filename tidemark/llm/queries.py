"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, byte_bpe, exact_dedup, fill_middle, hard_negatives, html_extract, language_id, lattice_lm, packing, secret_scan, sharding, simhash, substring_dedup
from tidemark.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lambda x: 256 * x.cast("double")
    # doubles from 2**62 on are whole as they are, and not finite ones stay what they are
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < float(1 << 62), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_byte_bpe, op3_ann, op4_html_extract, op5_substring_dedup, op6_simhash, op7_lattice_lm, op8_packing, op9_language_id, op10_secret_scan, op11_fill_middle, op12_hard_negatives, op13_sharding, pipeline)}


#: One bit of the CRC's table entry: written around itself eight times.
_CRC_STEP, _CRC_REST = "list_transform([", "], lambda y: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)[1]"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY norm)""",
        "op11_fill_middle": """
            WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents),
            d AS (SELECT *, len(tokens) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
            p AS (SELECT *, array_to_string(tokens[:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
        "op12_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
            p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same WHERE 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
            SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
        "op13_sharding": f"""
            WITH crc(made) AS (SELECT list_transform(range(256), lambda c: {_CRC_STEP * 8}c{_CRC_REST * 8})),
            d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
            h AS (SELECT doc_id, size, CAST('0x' || md5(t)[1:15] AS BIGINT) AS h,
              CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, crc.made[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
            p AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS pos, row_number() OVER w - 1 AS k, CAST(sum(size) OVER () AS BIGINT) AS total, max(size) OVER () AS largest FROM h WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
            g AS (SELECT h, min(pos) AS g_pos, min(k) AS g_k, CAST(sum(size) AS BIGINT) AS g_size, count(*) AS g_n FROM p GROUP BY h),
            a AS (SELECT s, total * s // 8 AS aim, CASE WHEN g_size <= greatest(total / 8 * 0.01, largest) THEN {{'pos': g_pos, 'k': g_k, 'size': g_size, 'n': g_n}} ELSE {{'pos': pos, 'k': k, 'size': size, 'n': 1}} END AS x FROM range(1, 8) r(s), p JOIN g USING (h) WHERE pos <= total * s // 8 AND pos + size > total * s // 8),
            e AS (SELECT CASE WHEN 2 * (aim - x.pos) < x.size THEN x.pos ELSE x.pos + x.size END AS edge, CASE WHEN 2 * (aim - x.pos) < x.size THEN x.k ELSE x.k + x.n END AS first FROM a)
            SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST((SELECT count(*) FROM e WHERE edge <= p.pos) AS INTEGER) AS shard, k - coalesce((SELECT max(first) FROM e WHERE edge <= p.pos), 0) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    }
