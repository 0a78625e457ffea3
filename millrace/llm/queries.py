"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import leaks
from .html_extract import extract_articles
from .merkle import verified_manifest
from .mixing import mix_sources
from .neighbours import search
from .packing import pack_documents
from .pii import pii_digest
from .quality import score_quality
from .repeats import without_repeats
from .runs import planted, run_digest
from .sharding import shard_documents
from .similarity import similar_components
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@_query("op2_pii_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@_query("op6_virtual_slot_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@_query("op10_quality_kernel_ridge")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op8_subset_sum_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@_query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@_query("op3_pigeonhole_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op7_toxicity_chain")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op9_maximal_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


@_query("op4_crf_article_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


@_query("op1_learned_partitions_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(planted(table(spark, sf_dir, "documents")))


@_query("op12_hierarchical_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, end=2)


@_query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard_join"] = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1),
                        lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s FROM words),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle
        WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * COUNT(*) >= 90 * (a.n + b.n - COUNT(*))),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, MIN(r.other) AS component_id
    FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
