"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.session import checkpointed

#: Usable bits of the hash: fifteen hexadecimal digits of an MD5.
HASH_BITS = 60
_STEP = 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key hashes like ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    shift = (F.lit(HASH_BITS) - depth) if isinstance(depth, Column) else F.lit(HASH_BITS - depth)
    return F.call_function("shiftright", F.col("h"), shift.cast("int"))


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Slot of ``high`` bits -> depth of its bucket, null where it must split further.

    A bucket stands at the smallest depth at which its bytes fit; deeper sums are
    never larger, so the slots of one bucket agree. A bucket of one hash value cannot split.
    """
    slots = rows.groupBy(_prefix(high).alias("slot")).agg(
        F.sum("bytes").alias("b"), F.min("h").alias("least"), F.max("h").alias("most")
    )
    slots = checkpointed(slots)
    levels = slots.select(
        "slot", "b", "least", "most", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")
    ).withColumn("p", F.call_function("shiftright", F.col("slot"), (F.lit(high) - F.col("d")).cast("int")))
    fits = (
        levels.groupBy("d", "p")
        .agg(F.sum("b").alias("b"), F.min("least").alias("least"), F.max("most").alias("most"))
        .filter((F.col("b") <= limit) | (F.col("least") == F.col("most")))
        .select("d", "p")
    )
    depth = levels.join(fits, ["d", "p"]).groupBy("slot").agg(F.min("d").alias("depth"))
    return slots.select("slot").join(depth, "slot", "left")


def shard(rows: DataFrame, limit: int) -> DataFrame:
    """Give each row of ``doc_id, bytes, h`` its shard; other columns pass through.

    Adds ``shard`` (the bucket's hash prefix as a string of bits), ``depth``, ``part``,
    ``shard_bytes`` and ``oversized``. Only buckets above ``limit`` bytes are split on another
    bit. Rows of one hash value (repeated keys) cannot be parted by bits; ``part`` then deals
    equal rows out so that each part fits. A row larger than the limit has a shard of its own,
    marked oversized. Rows without bytes weigh nothing. An empty table gives no rows.
    """
    rows = checkpointed(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, math.ceil(math.log2(max(1, total / limit))) + 2)
    placed = []
    while True:
        directory = checkpointed(_directory(rows, low, high, limit))
        found = rows.withColumn("slot", _prefix(high)).join(directory, "slot").drop("slot")
        placed.append(found.filter("depth is not null"))
        if high == HASH_BITS or directory.filter("depth is null").limit(1).count() == 0:
            break
        rows = checkpointed(found.filter("depth is null").drop("depth"))
        low, high = high, min(HASH_BITS, high + _STEP)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    out = out.withColumn(
        "shard", F.when(F.col("depth") > 0, F.expr("lpad(bin(shiftright(h, cast(60 - depth as int))), cast(depth as int), '0')")).otherwise("")
    )
    # What still exceeds the limit has one hash value: count equal rows, then deal them out.
    sums = checkpointed(out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows")))
    out = out.join(sums, "shard")
    small = out.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)).withColumn("part", F.lit(0).cast("long"))
    small = small.withColumn("oversized", F.col("shard_bytes") > limit)
    if sums.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).limit(1).count() == 0:
        return small.drop("shard_rows", "h")
    rest = out.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).drop("shard_bytes", "shard_rows")
    keys = [c for c in rest.columns]
    same = rest.groupBy(*keys).agg(F.count("*").alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    dealt = (
        same.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("nth", F.floor(F.col("copy") / per).cast("long"))
        .withColumn("filled", F.least(per, F.col("n") - F.col("nth") * per))
        .withColumn("part", F.pmod(F.xxhash64(*keys, "nth"), F.lit(1 << 62)) + 1)
        .withColumn("shard_bytes", F.col("filled") * F.col("bytes"))
        .withColumn("oversized", F.col("bytes") > limit)
    )
    return small.drop("shard_rows", "h").unionByName(dealt.select(*small.drop("shard_rows", "h").columns))
