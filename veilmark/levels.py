"""The class domain: six ordered levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.fixed_values import LEVELS


def level_table(spark: SparkSession) -> DataFrame:
    """``(idx, name, personal)``, six rows."""
    names = F.array(*[F.lit(n) for n in LEVELS])
    return spark.range(1).select(F.posexplode(names).alias("idx", "name")).withColumn(
        "personal", F.col("name").startswith("PERSONAL_")
    )


def level_name(idx: Column) -> Column:
    """Index 0..5 to level name; null outside the domain."""
    return F.get(F.array(*[F.lit(n) for n in LEVELS]), idx.cast("int"))
