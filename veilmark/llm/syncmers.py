"""Fingerprints of texts by closed syncmers, in DataFrame functions only.

A text is a row of words. Five neighbouring words are an anchor when, of the pairs of words inside them, the one
with the smallest hash stands at an edge. Whether they are depends on nothing around them, so texts that
share a passage share its anchors wherever it stands, and every stretch of some words has some.

Hashes are 60-bit whole numbers: of a word two remainders of its crc32, of several words the exclusive or of their hashes,
each rotated by its place. Everything is array functions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.session import written

#: A word, or a part of one without white space for 32 characters.
UNIT = r"[^\x20\x09-\x0D]{1,32}"
TURN = 11
#: Factor and prime of each half of a hash; a 32-bit crc times a factor stays below 2^62.
HASHES = ((1000000007, 1073741789), (812345677, 1073741783))
_MASK = (1 << 60) - 1
_ROW = (1 << 33) - 1


def _hash(text: Column) -> Column:
    """Two 30-bit remainders of multiples of the text's crc32: no such remainder is linear in the bits, as the crc is."""
    crc = F.crc32(text)
    high, low = ((crc * F.lit(factor)) % F.lit(prime) for factor, prime in HASHES)
    return F.shiftleft(high, 30).bitwiseOR(low)


def _turned(h: Column, by: int) -> Column:
    """60 bits rotated to the left."""
    by %= 60
    return h if by == 0 else F.shiftleft(h, by).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftright(h, 60 - by))


def _from(array: str, skip: int, size: Column) -> Column:
    """``size`` elements (none, if less) after the first ``skip``."""
    return F.slice(array, skip + 1, F.greatest(size, F.lit(0)))


def with_anchors(rows: DataFrame, text: str, out: str, words: int = 5, inner: int = 2) -> DataFrame:
    """Add ``out``: the anchors of the text, ``array<struct<place, id>>`` in order; ``place`` is a word number from 0.

    An anchor is ``words`` neighbouring words whose smallest stretch of ``inner`` words is the first or the
    last. A text without any (short ones) has one anchor at place 0 that stands for all its words; one
    without words, an empty or a null text has none. White space between words does not count.

    Each step is a column of its own, so that nothing is worked out twice.
    """
    spread = words - inner + 1
    if not 0 < inner < words:
        raise ValueError("inner stretches are shorter than an anchor")
    own, given = "_", set(rows.columns) - {out}
    while any(c.startswith(own) for c in given):
        own += "_"
    name = lambda c: f"{own}{c}"
    n = F.col(name("n"))
    rows = rows.withColumn(name("w"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)))
    rows = rows.withColumn(name("h1"), F.transform(name("w"), _hash)).withColumn(name("n"), F.size(name("w")))

    def hashed(size: int) -> str:
        """Name of the array of hashes of every ``size`` words, made from two shorter ones."""
        nonlocal rows
        if name(f"h{size}") not in rows.columns:
            half = 1 << ((size - 1).bit_length() - 1)
            first, rest, count = hashed(half), hashed(size - half), n - (size - 1)
            joined = F.zip_with(
                _from(first, 0, count), _from(rest, half, count), lambda a, b: a.bitwiseXOR(_turned(b, TURN * half))
            )
            rows = rows.withColumn(name(f"h{size}"), joined)
        return name(f"h{size}")

    ids, pairs = hashed(words), hashed(inner)
    least, width = pairs, 1
    while width < spread:
        step = min(width, spread - width)
        width, count = width + step, n - (inner - 1) - (width + step - 1)
        low = F.zip_with(_from(least, 0, count), _from(least, step, count), lambda a, b: F.least(a, b))
        rows, least = rows.withColumn(name(f"m{width}"), low), name(f"m{width}")
    count = n - (words - 1)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(name("p"), places).withColumn(name("a"), _from(pairs, 0, count))
    rows = rows.withColumn(name("b"), _from(pairs, spread - 1, count))
    zipped = F.arrays_zip(name("p"), ids, name("a"), name("b"), least)
    closed = F.filter(zipped, lambda z: (z[least] == z[name("a")]) | (z[least] == z[name("b")]))
    anchor = lambda z: F.struct(z[name("p")].alias("place"), z[ids].alias("id"))
    rows = rows.withColumn(name("c"), F.transform(closed, anchor))
    whole = F.array(F.struct(F.lit(0).alias("place"), _hash(F.array_join(name("w"), " ")).alias("id")))
    anchors = F.when((F.size(name("c")) > 0) | (n == 0), F.col(name("c"))).otherwise(whole)
    rows = rows.withColumn(out, anchors)
    return rows.drop(*[c for c in rows.columns if c.startswith(own) and c != out])


def fingerprint(anchors: Column) -> Column:
    """The anchors in order, eight hexadecimal digits each: equal texts have equal ones."""
    digits = lambda a: F.lpad(F.lower(F.hex(a["id"].bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")
    return F.array_join(F.transform(anchors, digits), " ")


def likeness(a: Column, b: Column) -> Column:
    """Anchors that both texts have, among all that one of them has; two texts without any are alike."""
    x, y = (F.transform(c, lambda e: e["id"]) for c in (a, b))
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / every)


def with_next(docs: DataFrame) -> DataFrame:
    """Every row as ``doc_id, text, next_text``, the text of the next row by descending ``doc_id`` (the last one is followed
    by the first), with ``part, at``, its place in that order, and ``guest`` on rows that stand for the next range only.

    Null ids come last, rows of one id by the md5 of their text, equal rows one after another; null texts are empty.
    Other columns are not read. The rows are sorted once by ranges, so no id however frequent is one
    group; each range also gets the first row of the next, and one row a range meets in one task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = rows.orderBy(F.desc_nulls_last("doc_id"), "digest", "row").select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "ordered").withColumn("part", F.shiftright("at", 33)).withColumn("guest", F.lit(False))
    heads = rows.filter(F.col("at").bitwiseAND(F.lit(_ROW)) == 0)
    last = heads.agg(F.max("part").alias("last"))
    before = heads.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    before = before.join(last).select("part", F.coalesce("before", "last").alias("before"))
    guests = heads.join(before, "part").select(
        "doc_id", "text", F.lit((1 << 63) - 1).alias("at"), F.col("before").alias("part"), F.lit(True).alias("guest")
    )
    order = Window.partitionBy("part").orderBy("at")
    return rows.unionByName(guests).withColumn("next_text", F.lead("text").over(order))


def edited(text: Column, other: Column) -> Column:
    """The text with the last half of its characters (rounded down) replaced by as many first ones of the other, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like the text is to that and to the next text.

    Returns ``doc_id, n_chars, edited_text, anchors, edited_anchors, near_edited, near_next``, a row for every row of ``docs``,
    equal rows included. See :func:`with_next` for the order and for nulls. An empty table gives no rows.
    """
    order = Window.partitionBy("part").orderBy("at")
    rows = with_anchors(with_next(docs), "text", "anchors")
    rows = rows.withColumn("next_anchors", F.lead("anchors").over(order)).filter(~F.col("guest"))
    rows = rows.withColumn("near_next", likeness(F.col("anchors"), F.col("next_anchors")))
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).drop("next_text", "next_anchors")
    rows = with_anchors(rows, "edited_text", "edited_anchors")
    rows = rows.withColumn("near_edited", likeness(F.col("anchors"), F.col("edited_anchors")))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited_text", "anchors", "edited_anchors", "near_edited", "near_next")
