"""Files to text: scan, size guard, routing by suffix, extraction with a status."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.fixed_values import MAX_FILE_BYTES, MIN_TEXT_CHARS
from veilmark.functions.html import with_html_text
from veilmark.sources import office
from veilmark.sources.readers import NO_TEXT, SETTLED, Reader, read_in_stages

TEXT, HTML = (".txt", ".md"), (".html", ".htm")
OFFICE = {".docx": office.docx_text, ".xlsx": office.xlsx_text, ".pptx": office.pptx_text}
PARSED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("detail", T.StringType())]
)


def scan_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per file: path, modificationTime, length, content (read only if used)."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def with_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("filename", filename(F.col(path))).withColumn(
        "extension", extension(F.col("filename"))
    )


def megabytes(size: Column) -> Column:
    return F.format_string("%.1f MB", size / 1048576.0)


def is_oversized(size: Column, limit: int = MAX_FILE_BYTES) -> Column:
    return size > F.lit(limit)


def route(ext: Column, extra: tuple[str, ...] = ()) -> Column:
    """The reader for a suffix: text, html, an office format, or null."""
    chain = F.when(ext.isin(*TEXT), "text").when(ext.isin(*HTML), "html")
    for suffix in (*OFFICE, *extra):
        chain = chain.when(ext == suffix, suffix[1:])
    return chain


def status_of(ext: Column, size: Column, limit: int = MAX_FILE_BYTES, extra: tuple[str, ...] = ()) -> Column:
    """The status known before any content is read; ``ok`` if it may be read."""
    return (
        F.when(is_oversized(size, limit), "oversized")
        .when(route(ext, extra).isNull(), "unsupported_format")
        .otherwise("ok")
    )


def detail_of(ext: Column, size: Column, limit: int = MAX_FILE_BYTES, extra: tuple[str, ...] = ()) -> Column:
    bound = f" > {limit / 1048576:.0f} MB limit" if limit >= 1048576 else f" > {limit} bytes limit"
    return (
        F.when(is_oversized(size, limit), F.concat(megabytes(size), F.lit(bound)))
        .when(route(ext, extra).isNull(), F.concat(F.lit("'"), ext, F.lit("' not supported")))
    )


def decoded(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1; line ends become ``\\n``."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def _parser(readers: dict[str, Callable[[bytes], str]]):
    """Arrow UDF: bytes and suffix to text; an exception becomes a detail message."""

    @F.arrow_udf(PARSED)
    def parse(content: pa.Array, suffix: pa.Array) -> pa.Array:
        rows = []
        for data, ext in zip(content, suffix):
            reader = readers.get(ext.as_py())
            if reader is None or not data.is_valid:
                rows.append(None)
                continue
            try:
                rows.append({"text": reader(data.as_py()), "detail": None})
            except Exception as error:  # a broken file is a row, not a failed job
                rows.append({"text": None, "detail": f"{type(error).__name__}: {error}"})
        return pa.array(rows, pa.struct([("text", pa.string()), ("detail", pa.string())]))

    return parse


def extract(
    files: DataFrame,
    limit: int = MAX_FILE_BYTES,
    readers: dict[str, Callable[[bytes], str] | Sequence[Reader]] | None = None,
) -> DataFrame:
    """Replace ``content`` by ``text``, ``extraction_status``, ``extraction_detail``.

    ``readers`` adds formats: suffix to a function from bytes to text, for
    instance ``{".pdf": my_reader}``, or to a list of readers that are tried in turn (see
    :mod:`veilmark.sources.readers`). Files over the limit or of an unknown
    format form a branch of their own that never touches ``content``.
    """
    chains = {s: r for s, r in (readers or {}).items() if not callable(r)}
    known = {s: r for s, r in {**OFFICE, **(readers or {})}.items() if s not in chains}
    extra = tuple(s for s in (*known, *chains) if s not in OFFICE)
    rows = with_metadata(files)
    ext, size = F.col("extension"), F.col("length")
    early = status_of(ext, size, limit, extra)
    kept = [c for c in rows.columns if c != "content"]

    refused = rows.filter(early != "ok").select(
        *kept,
        F.lit(None).cast("string").alias("text"),
        early.alias("extraction_status"),
        detail_of(ext, size, limit, extra).alias("extraction_detail"),
    )
    readable = rows.filter(~is_oversized(size, limit)).filter(route(ext, extra).isNotNull())
    parse = _parser(known)
    plain = decoded(F.col("content"))
    read = (
        readable.withColumn("_decoded", F.when(ext.isin(*TEXT, *HTML), plain))
        .withColumn("_parsed", parse(F.when(ext.isin(*known), F.col("content")), ext))
    )
    outcome = F.lit(None).cast(SETTLED)
    for k, (suffix, stages) in enumerate(chains.items()):
        read = read_in_stages(read.withColumn("_given", F.when(ext == suffix, F.col("content"))), "_given", stages, out=f"_chain{k}")
        outcome = F.when(ext == suffix, F.col(f"_chain{k}")).otherwise(outcome)
    read = (
        read.withColumn("_outcome", outcome)
        .drop("content", "_given", *[f"_chain{k}" for k in range(len(chains))])
        .withColumn("_html", F.when(ext.isin(*HTML), F.col("_decoded")))
    )
    read = with_html_text(read, "_html", "_html_text", "_html_error").withColumn(
        "text",
        F.when(ext.isin(*HTML), F.col("_html_text"))
        .when(ext.isin(*TEXT), F.col("_decoded"))
        .otherwise(F.col("_parsed.text")),
    )
    chained = ext.isin(*chains) if chains else F.lit(False)
    problem = F.coalesce("_parsed.detail", "_html_error")
    failed = problem.isNotNull()
    short = ext.isin(".pdf") & ~chained & (F.length(F.trim("text")) < MIN_TEXT_CHARS)
    read = read.select(
        *kept,
        F.when(chained, F.col("_outcome.text")).when(~short, F.col("text")).alias("text"),
        F.when(chained, F.col("_outcome.status")).when(failed, "extraction_failed").when(short, "no_text_layer").otherwise("ok").alias("extraction_status"),
        F.when(chained, F.col("_outcome.detail")).when(failed, problem).when(short, NO_TEXT).alias("extraction_detail"),
    )
    return read.unionByName(refused)


def first_long_enough(*candidates: Column, least: int = MIN_TEXT_CHARS) -> Column:
    """The first candidate text with at least ``least`` characters; else null."""
    return F.coalesce(*[F.when(F.char_length(F.trim(c)) >= least, c) for c in candidates])
