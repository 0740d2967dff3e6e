"""Query of the units problem over the labelled amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.operators.units import harmonise, held_out
from finstrata.runtime import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    amounts = harmonise(table(spark, d, "gold_rows"))
    return amounts.where(~F.col("is_plain") & F.col("amount").isNotNull()).select("gold_id", "currency_code", "amount")


def p6_amounts(spark: SparkSession, d: str) -> DataFrame:
    return harmonise(table(spark, d, "gold_rows")).select("gold_id", "currency_code", "amount", "unit_source", "confidence")


def p6_held_out(spark: SparkSession, d: str) -> DataFrame:
    """The forest's answers on a tenth of the rows, their units hidden: how far its confidence can be trusted."""
    return held_out(table(spark, d, "gold_rows"))


QUERIES = {f.__name__: f for f in (p6_found, p6_amounts, p6_held_out)}
SQL: dict[str, str] = {}
