"""The value rule as a SQL function, so plain SQL views can call it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .columns import SECONDS_PER_MONTH, SECONDS_PER_YEAR


def register(spark: SparkSession, name: str = "equipment_value") -> str:
    """Create ``name(price, rate, purchased, as_of)`` as a session SQL function."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
            price DECIMAL(10,2), rate DECIMAL(5,2),
            purchased TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ)
        RETURNS DECIMAL(20,2)
        RETURN CAST(greatest(
            CAST(0 AS DECIMAL(10,2)),
            price - price * rate
                * CAST(round(months_between(as_of, purchased, false) * {SECONDS_PER_MONTH})
                       AS DECIMAL(12,0))
                / CAST({SECONDS_PER_YEAR} AS DECIMAL(8,0))) AS DECIMAL(20,2))
    """)
    return name
