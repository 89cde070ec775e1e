"""The registered queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, infill, languages, maxent, mixing, neighbours, pii, preferences, prefixes, simhash, suffixes, tokencount, toxicity
from .common import crc_mod, read
from .oracles import ORACLES


def held_out(n: int, remainder: int) -> Column:
    """Rows without an id are never learned from."""
    return F.coalesce(crc_mod("doc_id", n) == remainder, F.lit(True)).alias("held_out")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1), "score", predicted)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return maxent.score(docs, maxent.fit(docs))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return languages.predict(docs, *languages.fit(docs)).select("doc_id", held_out(5, 0), "lang_pred", "score", "n_langs")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.adjacent_pairs(read(spark, sf_dir, "conversations")))
    masks = {c: preferences.listed(c) for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(masks)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.shared_heads(prefixes.turns(read(spark, sf_dir, "conversations"))))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(read(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_neighbours": op3_neighbours,
        "op4_language_model": op4_language_model,
        "op5_languages": op5_languages,
        "op6_mix_sources": op6_mix_sources,
        "op7_simhash": op7_simhash,
        "op8_pii": op8_pii,
        "op9_token_count": op9_token_count,
        "op10_preferences": op10_preferences,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_infill": op12_infill,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
