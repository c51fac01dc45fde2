"""Dimension tables: plain rows with explicit schemas, all of fixed, small size.

Callers may pass their own version of any of them to the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import CHECKS, RULES
from .criteria import CRITERIA
from .rules import CONSENT_PLATFORMS, RULE_CRITERIA, VENDOR_RULES

CRITERIA_SCHEMA = (
    "criterion string, title string, level string, principle string, automation string, "
    "baseline boolean, plain_language string, affected_users array<string>"
)
TEXT_SCHEMA = (
    "text_key string, cat_title string, cat_description string, cat_remediation string, cat_code string, "
    "cat_owner string, cat_effort string, cat_confidence double"
)


def criteria(spark: SparkSession) -> DataFrame:
    """Success criteria: 50 in the binding baseline, 6 recommended on top (H8)."""
    return spark.createDataFrame(CRITERIA, CRITERIA_SCHEMA)


def texts(spark: SparkSession) -> DataFrame:
    """Texts, owner, effort and confidence per check; rule-engine rules are keyed ``axe:<rule>``."""
    rows = [(k, *v) for k, v in CHECKS.items()] + [(f"axe:{k}", *v) for k, v in RULES.items()]
    return spark.createDataFrame(rows, TEXT_SCHEMA)


def rule_criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in RULE_CRITERIA.items()], "rule_id string, rule_criteria array<string>")


def vendor_rule_rows() -> list[tuple[int, str, str, str, str, str]]:
    return [(i, *r) for i, r in enumerate(VENDOR_RULES)]


def consent_platforms(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(CONSENT_PLATFORMS)]
    return spark.createDataFrame(rows, "platform_order int, platform string, attr string, value string, container string")


def or_own(table: DataFrame | None, own: DataFrame) -> DataFrame:
    """A caller's table as it is, sized by Spark; our own closed list with a broadcast hint."""
    return table if table is not None else F.broadcast(own)
