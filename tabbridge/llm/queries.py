"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbridge.llm import (
    alignment,
    decontamination,
    digest_tree,
    language,
    mixing,
    neighbours,
    ngram_join,
    passages,
    periodic,
    quality,
    sharding,
    tokens,
    urls,
)
from tabbridge.llm.staging import result, scratch, step_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@_query("op1_entropy_mix")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = _load(spark, folder, "documents")
    with scratch(spark, "mix") as tables:
        rows, sources = mixing.plan_mix(docs, tables)
        dealt = mixing.copies(rows, sources)
        return result(
            dealt.select(
                "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                "source", "rate", "copies",
            ),
            "mix",
        )


@_query("op2_kd_shards")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_load(spark, folder, "documents"), 40)


_OP3 = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (
  SELECT r, i, item_id, place.n FROM place JOIN win ON place.n = win.n AND array_to_string(place.w[i : i + place.n - 1], ' ') = win.t),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@_query("op3_wu_manber", _OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(_load(spark, folder, "documents"), _load(spark, folder, "benchmark"))


@_query("op4_path_templates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_load(spark, folder, "pages"))


@_query("op5_attention_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(_load(spark, folder, "documents"), _load(spark, folder, "labels"))


_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""


@_query("op6_pivot_top_k", _OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.top_k(_load(spark, folder, "embeddings"))


@_query("op7_partenum_join")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(_load(spark, folder, "documents"))


@_query("op8_phrase_automata")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeated_passages(_load(spark, folder, "documents"))


@_query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenize_documents(_load(spark, folder, "documents"))


@_query("op10_language_svm")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_load(spark, folder, "documents"))


@_query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(_load(spark, folder, "documents"), change=periodic.repeat_tails)
    with step_settings(spark):
        return result(periodic.run_digests(found), "runs")


@_query("op12_merge_path_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_digests(_load(spark, folder, "documents"))


_OP13 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


@_query("op13_digest_tree", _OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return digest_tree.equal_texts(_load(spark, folder, "documents"))
