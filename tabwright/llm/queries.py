"""The queries of this subpackage, each beside the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm.ball_codes import CODES_SQL, compressed
from tabwright.llm.bpe import encode_decode
from tabwright.llm.fingerprints import simhash_components
from tabwright.llm.languages import identify
from tabwright.llm.graph_search import nearest
from tabwright.llm.mixing import ORACLE as MIX_SQL
from tabwright.llm.mixing import mix
from tabwright.llm.mtree import top_products
from tabwright.llm.near_dedup import near_duplicates
from tabwright.llm.pitman_yor import score_texts
from tabwright.llm.suffix_dedup import remove_repeats
from tabwright.llm.toxicity import score_toxicity
from tabwright.llm.token_files import through_files
from tabwright.llm.whitening import by_component, whiten

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "extra")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids", "decoded")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held_out=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, labels, folds=4, held_out=2)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(table(spark, sf_dir, "embeddings")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


PRODUCT_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_lm_score, op4_mix_sources, op5_language_id, op6_near_dedup, op7_graph_search, op8_toxicity, op9_mtree_search, op10_token_files, op11_whitening, op12_simhash, op13_ball_codes)}
ORACLES: dict[str, str] = {"op4_mix_sources": MIX_SQL, "op9_mtree_search": PRODUCT_SQL, "op13_ball_codes": CODES_SQL}
