"""The numbered queries, and their SQL where a second engine can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm import (
    bpe,
    html_text,
    language,
    neardup,
    packing,
    prefix_trie,
    quality,
    repeats,
    runs,
    secret_scan,
    sharding,
    shingle_join,
    topk,
)

SHARDS = 8
SEQUENCE = 2048


def word_vocabulary() -> str:
    """Place of the public word-end vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    profiles = language.learn(docs.filter(~held_out))
    return language.identify(docs, profiles, keep=["doc_id", held_out.alias("held_out")])


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_records(table(spark, sf_dir, "documents"), weights=[1.0] * SHARDS)
    return rows.withColumn("law", F.lit("key"))


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op4_tree_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    extractor = html_text.learn(html_text.training_pages(pages))
    return html_text.extract(pages, extractor).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding"), 1024).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0)


#: From this score on a document is taken for label 1.
GOOD = 0.3


def op6_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    texts, marks = quality.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda key: remainder(key, 5) != 0)
    scored = quality.score(docs, quality.train(texts, marks), keep=["doc_id", held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op7_bitmap_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), SEQUENCE)


def op9_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op11_block_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.share_beginnings(prefix_trie.number_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)


def planted_period(decimal: bytes, n: int) -> np.ndarray | None:
    """In one document of ten, the words from a place on repeat a stretch of themselves."""
    h = zlib.crc32(decimal)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op12_octave_tile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)


def op13_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rank_order_language": op1_rank_order_language,
        "op2_rendezvous_sharding": op2_rendezvous_sharding,
        "op3_tree_bpe": op3_tree_bpe,
        "op4_tree_html_text": op4_tree_html_text,
        "op5_norm_bucket_topk": op5_norm_bucket_topk,
        "op6_quality_network": op6_quality_network,
        "op7_bitmap_jaccard_join": op7_bitmap_jaccard_join,
        "op8_bin_completion_packing": op8_bin_completion_packing,
        "op9_cross_polytope_dedup": op9_cross_polytope_dedup,
        "op10_secret_scan": op10_secret_scan,
        "op11_block_prefix_trie": op11_block_prefix_trie,
        "op12_octave_tile_runs": op12_octave_tile_runs,
        "op13_prefix_free_dedup": op13_prefix_free_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
