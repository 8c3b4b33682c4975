"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, mixing, negatives, ngram_join, packing, part_codes, quality, simhash, token_binary, token_counts, topk, warc
from .common import table

VOCABULARY = "byte_bpe_50k.json"
MIX_WEIGHTS = {"clean": 0.86, "low": 0.07, "toxic": 0.07}


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.largest(table(spark, sf_dir, "embeddings"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS)


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op10_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_binary(table(spark, sf_dir, "documents"), vocabulary())


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is off by one, as labels of mined pairs are."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_permutation_index, op2_norm_bucket_topk, op3_soft_mixing, op4_compression_quality, op5_block_text, op6_ngram_jaccard_join, op7_warc_shards, op8_swap_packing, op9_token_counts, op10_bitplane_tokens, op11_part_codes, op12_hard_negatives, op13_gray_simhash)}


def part_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codes by product quantisation: a codebook and an assignment a round."""
    out = [f"""v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS MATERIALIZED (SELECT vec_id, p, list_slice(e, p * (len(e) // {parts}) + 1, (p + 1) * (len(e) // {parts})) AS s FROM v, range({parts}) t(p)),
        c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s AS c FROM s WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, s.p, k, s, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(s, c)]) AS BIGINT) AS d FROM s JOIN c{r} c ON c.p = s.p)
            QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT p, k, list(x ORDER BY i) AS m
                FROM (SELECT p, k, i, CAST(floor(sum(s[i]) / count(*)) AS BIGINT) AS x FROM a{r}, (SELECT unnest(range(1, (SELECT len(any_value(s)) FROM s) + 1)) AS i) GROUP BY ALL) GROUP BY p, k) USING (p, k))""")
    return f"""WITH {", ".join(out)}, e AS (SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM e JOIN v USING (vec_id)"""


#: The integer products and quantisation are SQL; hashes, tokenizers, compression and markup are not, and are tested against brute force.
ORACLES = {
    "op2_norm_bucket_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op11_part_codes": part_codes_sql(),
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, b.e)]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
