"""Secret scans judged by how widely a value is owned in the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm.common import bit_table, in_bits, mapped
from veilmark.session import forget, written

# Fixed patterns of the scan, as its contract states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "owned")

#: Values without a telling name: long, with letters and digits, few repeats.
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT = re.compile(r"[0-9]")
_MIN_BITS = 3.5

_SCHEMA = "kinds array<int>, starts array<int>, ends array<int>, hashes array<string>"


def entropy(value: str) -> float:
    """Bits per character of a value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """Kind (index into KINDS), start, end and value of each finding, by start, then kind.

    The first three kinds are the base rule. The last is a loose candidate that no base finding touches.
    """
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _DIGIT.search(text) or len(text) >= 32:
        found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
        base = list(found)
        for m in LOOSE.finditer(text) if _DIGIT.search(text) else ():
            a, b, v = *m.span(), m[0]
            if any(s < b and a < e for _, s, e, _ in base) or not _DIGIT.search(v) or not re.search("[A-Za-z]", v):
                continue
            if entropy(v) >= _MIN_BITS:
                found.append((3, a, b, v))
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """All candidates of each whole text as arrays next to the columns ``keep``; narrow."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [
                    pa.array([[c[0] for c in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[c[1] for c in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[c[2] for c in r] for r in rows], pa.list_(pa.int32())),
                    pa.array([[hashlib.sha256(c[3].encode()).hexdigest()[:32] for c in r] for r in rows], pa.list_(pa.string())),
                ],
                names=[*keep, "kinds", "starts", "ends", "hashes"],
            )

    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return source.mapInArrow(mapped(find), f"{head}, {_SCHEMA}")


def ownership(scanned: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """``hash, repositories, owners``: how many distinct repositories and owners hold a value.

    Every (value, repository, owner) is reduced to one row first, so a value copied into a
    third of the corpus costs one row a task. A null repository or owner counts as one of its own.
    """
    one = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    held = scanned.select(
        F.explode("hashes").alias("hash"), one(repository).alias("repository"), one(owner).alias("owner")
    ).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("r").alias("repositories"), F.count("*").alias("owners"))


def judged(scanned: DataFrame, owned: DataFrame, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """Per row key: ``spans`` (kind, start, end, live), loose candidates only where live.

    A value is live when at most ``max_owners`` owners and ``max_repositories`` repositories
    hold it; what is copied more widely is an example. Base findings always stay, marked
    ``live`` or not. ``scanned`` needs a column ``row_key`` that is equal only for equal texts.
    """
    rows = scanned.filter(F.size("kinds") > 0).dropDuplicates(["row_key"]).select(
        "row_key", F.explode(F.arrays_zip("kinds", "starts", "ends", "hashes")).alias("c")
    ).select("row_key", F.col("c.hashes").alias("hash"), F.struct("c.starts", "c.kinds", "c.ends").alias("s"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    known = owned.select("hash", live.alias("live"))
    kept = rows.join(known, "hash").filter((F.col("s.kinds") < 3) | F.col("live"))
    return kept.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("s.starts").alias("start"), F.col("s.kinds").alias("kind"), F.col("s.ends").alias("end"), "live"))).alias("found")
    )


def row_key() -> Column:
    """Equal for rows of one id and text."""
    return F.xxhash64("doc_id", "text")


def scan_and_judge(docs: DataFrame, repository: Column, owner: Column, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (``keep`` and ``row_key``), and per row key the ``found`` spans that stay.

    The scan is written once; what follows sees one row per value and holder, and texts never move.
    """
    named = docs.select(
        *(F.col(c) for c in keep if c != "text"), row_key().alias("row_key"), repository.cast("string").alias("its_repository"),
        owner.cast("string").alias("its_owner"), "text",
    )
    scanned = written(scan(named, [c for c in named.columns if c != "text"]), "secrets")
    return scanned, judged(scanned, ownership(scanned, F.col("its_repository"), F.col("its_owner")))


def find_secrets(docs: DataFrame, repository: Column, owner: Column, keep: list[str]) -> DataFrame:
    """Each row's columns ``keep`` and ``found``: its spans by start, then kind (``KINDS``).

    ``found`` is an array of (start, kind, end, live) in code points, end exclusive; empty for texts without
    findings, and for null and empty texts. Rows that repeat, also with a null id, are each returned.
    """
    scanned, verdicts = scan_and_judge(docs, repository, owner, keep)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    joined = scanned.select(*keep, "row_key").join(verdicts, "row_key", "left")
    return joined.select(*keep, F.coalesce("found", empty).alias("found"))


def masked(docs: DataFrame, repository: Column, owner: Column, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; overlapping findings are one. Other columns
    stay, whatever their names.

    A table of bits tells which texts may hold a finding; only these move, to their spans. ``docs`` is read a few times, so
    it should be stored.
    """
    scanned, verdicts = scan_and_judge(docs, repository, owner, ["doc_id"])
    verdicts = written(verdicts, "verdicts")
    forget(scanned)
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(verdicts, "row_key"))

    @F.arrow_udf(T.BooleanType())
    def may_hold(keys: pa.Array) -> pa.Array:
        return pa.array(in_bits(bits.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    cut = F.expr(
        "aggregate(found, struct('' as t, 0 as at), (a, s) -> if(s.`end` <= a.at, a, struct("
        "if(s.start >= a.at, concat(a.t, substr(row.text, a.at + 1, s.start - a.at), '" + mask + "'), a.t) as t, s.`end` as at)), "
        "a -> concat(a.t, substr(row.text, a.at + 1)))"
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("row_key")).withColumn("held", may_hold("row_key"))
    changed = rows.filter("held").join(verdicts, "row_key", "left")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(cut)
    changed = changed.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return changed.unionByName(rows.filter("not held").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
