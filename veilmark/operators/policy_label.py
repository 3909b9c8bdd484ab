"""The full labelling rule: stamp, content, personal floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import policy
from veilmark.levels import level_name
from veilmark.operators import lexicon as lx


def policy_label(
    df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text", enough: int = 2
) -> DataFrame:
    """Add stamp, content level, ``level_idx``, ``level`` and ``review``.

    The label is taken from the text as it stands; mask it afterwards with
    ``anonymise`` if needed.
    """
    t = F.col(text)
    out = lx.with_hits(df, lexicon, id_col, text)
    return (
        out.withColumn("stamp", policy.stamp(t))
        .withColumn("content", lx.best_level(F.col("hits")))
        .withColumn("has_pii", policy.has_personal_data(t))
        .withColumn(
            "_base",
            policy.stamp_or_content(
                F.col("stamp"), F.col("content"), F.array_max("hits"), enough
            ),
        )
        .withColumn("level_idx", policy.personal_floor(F.col("_base"), F.col("has_pii")))
        .withColumn("level", level_name(F.col("level_idx")))
        .withColumn("review", policy.needs_review(F.col("level_idx"), F.col("has_pii")))
        .drop("_base", "hits")
    )


def anonymise(df: DataFrame, text: str = "text") -> DataFrame:
    """Mask the text; columns computed before keep the original's values."""
    return policy.with_anonymised(df, text)
