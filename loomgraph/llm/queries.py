"""Queries of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .addresses import same_places
from .fusion import fused_survivors, survivors
from .leakage import leaked_passages
from .matching import company_records
from .names import name_variants
from .packing import pack
from .residue import template_residue


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants(load(spark, d, "purchase_orders"), load(spark, d, "entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return same_places(load(spark, d, "logistics_fulfillment"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(load(spark, d, "entities")).select("canonical_id", "field", "entity_id")


def p4_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return fused_survivors(load(spark, d, "entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_confidence(spark, d).select("src_table", "src_key", "entity_id")


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    return company_records(load(spark, d, "purchase_orders"), load(spark, d, "logistics_fulfillment"), load(spark, d, "entities"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(load(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p4_found, p4_posteriors, p6_found, p6_confidence, p7_pack, p8_found, p9_found)}
