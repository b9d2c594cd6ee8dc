"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_products(loans: DataFrame, cards: DataFrame, card_product: str) -> DataFrame:
    """Distinct union of loans ``(id, product, contract, search_id)`` and cards
    ``(id, contract, search_id)``, brought to one type; cards get one constant product."""
    left = loans.select(
        F.col("id").cast("bigint").alias("income_value"),
        F.col("product").cast("string").alias("product"),
        F.lit("").alias("contract_number"),
        F.col("search_id").cast("string").alias("search_id"),
    )
    right = cards.select(
        F.col("id").cast("bigint").alias("income_value"),
        F.lit(card_product).alias("product"),
        F.col("contract").cast("string").alias("contract_number"),
        F.col("search_id").cast("string").alias("search_id"),
    )
    return left.unionByName(right).distinct()


def union_candidates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates of two rankings with the rank each gave, NULL where it gave none."""
    return left.join(right, keys, "outer")
