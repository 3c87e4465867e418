"""Rule mining from claims to stored filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimloom.operators import enrich, mining
from claimloom.sizing import reuse


def mine_rules(
    claims: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    min_support: float = mining.MIN_SUPPORT,
    min_confidence: float = mining.MIN_CONFIDENCE,
    min_lift: float = mining.MIN_LIFT,
    limit: int | None = None,
) -> DataFrame:
    """Transactions -> itemsets -> rules -> lift filter -> filter rows."""
    baskets = enrich.transactions(claims, diagnoses, procedures, limit)
    itemsets = reuse(mining.frequent_itemsets(baskets, min_support))
    rules = mining.association_rules(itemsets, min_confidence)
    return mining.rule_definitions(mining.filter_by_lift(rules, min_lift))
