"""The corpus operators' queries and SQL, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import articles, centroids, counts, decontaminate, embeddings, itemsets, language, mixing, quality, sharding, simhash, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_simhash": simhash.query,
    "op3_language": language.query,
    "op4_decontaminate": decontaminate.query,
    "op5_token_counts": counts.query,
    "op6_token_ids": tokens.query,
    "op7_sharding": sharding.query,
    "op8_embeddings": embeddings.query,
    "op9_mixing": mixing.query,
    "op10_quality": quality.query,
    "op11_itemsets": itemsets.query,
    "op12_articles": articles.query,
    "op13_centroids": centroids.query,
}

SQL: dict[str, str] = {"op11_itemsets": itemsets.SQL}
