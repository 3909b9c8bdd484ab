"""Mixing sources to target weights by budgets cut from a random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import WORD, parts_for, word_count
from veilmark.llm.sharding import HASH_BITS, hash_bits
from veilmark.session import checkpointed, written

_ROWS_PER_BUCKET = 5_000
_BUCKETS = 256


def targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Target size of each source: ``source, source_size`` in; ``target`` added.

    Sources in code point order, null last, take the weights in turn. Everything is shared
    by weight; a target above ``cap`` times its source stops there, and what is left over is
    shared again among the others until none is above. Each round brings two sums to the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = checkpointed(totals.withColumn("weight", F.get(cycle, place % len(weights))))
    top = F.col("source_size") * F.lit(float(cap))
    level, full = float("inf"), -1
    while True:
        above = top < F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        row = totals.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, top).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("int")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == full or not row["open"]:
            break
        level, full = (row["all"] - row["stopped"]) / row["open"], row["n"]
    level = level if full >= 0 else 0.0
    return totals.withColumn("target", F.least(top, F.col("weight") * F.lit(level))).drop("weight")


def mix(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """Decide how many words of each row the mix takes.

    ``rows`` needs ``doc_id, source, size`` and ``content`` (a hash of the text, so that rows
    with one id get different keys); other columns pass through. Adds ``source_size``,
    ``target`` and ``taken``. A budget that covers its source several times takes every row as
    often; the rest is cut from the source's random order, in the middle of a row if need be, so
    the sum of ``taken`` is the target rounded to a whole word.

    The keys are hashes, so equal ranges of keys hold equal shares of a source: each range is
    one group, its offset is the prefix sum over the earlier ranges, and only rows of one range
    are sorted together, however large the source is. Empty input gives no rows; a null
    source is a source; null ids and sizes of 0 are allowed; equal rows are told apart by
    nothing, so they share a key and stand next to each other.
    """
    n = rows.count()
    bits = parts_for(n, _ROWS_PER_BUCKET, _BUCKETS).bit_length()
    key = hash_bits(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "content"))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.shiftright("key", HASH_BITS - bits))
    per_bucket = checkpointed(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    wanted = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    wanted = wanted.withColumnRenamed("source", "its_source")
    ranges = ranges.join(wanted, F.col("source").eqNullSafe(F.col("its_source"))).select(
        F.col("source").alias("range_source"), F.col("bucket").alias("range_bucket"), "offset", "source_size", "target"
    )
    joined = keyed.join(
        ranges, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("bucket") == F.col("range_bucket"))
    )
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(order), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return (
        joined.withColumn("before", before)
        .withColumn("taken", (epochs * F.col("size") + part).cast("long"))
        .drop("key", "bucket", "offset", "before", "range_source", "range_bucket")
    )


def taken_texts(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row as often as it is taken whole, and one shortened row
    where a budget ends inside a text: its first words, joined by blanks. Rows of which nothing is taken go.

    The rows are numbered and stored once; the mix is decided on numbers, sources and sizes, and each text moves
    once, to its decision. All columns of ``docs`` stay, whatever their names.
    """
    numbered = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "mixed_rows")
    sized = numbered.select("at", F.col("row.doc_id"), F.col("row.source"), word_count(F.col("row.text")).alias("size"), F.md5("row.text").alias("content"))
    mixed = mix(written(sized, "mixed_sizes"), **options).filter("taken > 0").select("at", "size", "taken")
    turns = numbered.join(mixed, "at").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("turn") - 1) * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), 0), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("size"), first).otherwise(F.col("row.text"))
    return turns.select(*(text.alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))
