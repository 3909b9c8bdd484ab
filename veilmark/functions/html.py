"""HTML to text: one line per text node."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = [
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"(?s)<!--.*?-->",
    r"<[A-Za-z/!?][^>]*>",
]
# `&amp;` comes last, so that `&amp;lt;` becomes `&lt;` and no more.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
_CUT = "\u0000"
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"


# One piece of markup: a comment, an element whose contents are no text, a tag, a declaration. What is cut off at the end
# of the page reaches to its end. Possessive repeats keep the search linear in the length of the page.
_MARKUP = re.compile(
    r"""
    <!--.*?(?:--!?>|\Z)
  | <(?P<unseen>script|style)(?=[\s/>])(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=unseen)(?=[\s/>])[^>]*(?:>|\Z)|\Z)
  | <textarea(?=[\s/>])(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>(?P<verbatim>.*?)(?:</textarea(?=[\s/>])[^>]*(?:>|\Z)|\Z)
  | </?[A-Za-z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+(?:>|\Z)
  | <!\[(?P<section>[^\[\]>\s]*)[^>]*(?:>|\Z)
  | <[/!?][^>]*(?:>|\Z)
    """,
    re.VERBOSE | re.IGNORECASE | re.DOTALL,
)
_SECTIONS = ("", "cdata", "if", "else", "endif")


def text_spans(html: str) -> Iterator[str]:
    """The stretches of text between markup, entities decoded, in order.

    A script or style element ends at its first closing tag, however it is nested; one that is left
    open takes the rest of the page. Tags in a textarea are text. A marked section of an unknown kind is an error.
    """
    at = 0
    for markup in _MARKUP.finditer(html):
        yield unescape(html[at : markup.start()])
        at = markup.end()
        if markup["verbatim"]:
            yield unescape(markup["verbatim"])
        if (markup["section"] or "").lower() not in _SECTIONS:
            raise ValueError(f"marked section of unknown kind: {markup['section']}")
    yield unescape(html[at:])


def parsed_text(html: str) -> str:
    """The same result as the patterns below, for pages that they do not cover."""
    return "\n".join(line for line in (span.strip() for span in text_spans(html)) if line)


_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_PARSED_ARROW = pa.struct([("text", pa.string()), ("error", pa.string())])


def _parsed_row(html: str | None) -> dict | None:
    """A page that the parser cannot read is a row with a message, not a failed job."""
    if html is None:
        return None
    try:
        return {"text": parsed_text(html), "error": None}
    except Exception as error:
        return {"text": None, "error": f"{type(error).__name__}: {error}"}


@F.arrow_udf(_PARSED)
def _parse(html: pa.Array) -> pa.Array:
    return pa.array([_parsed_row(h) for h in html.to_pylist()], _PARSED_ARROW)


def _marked(html: Column) -> Column:
    for pattern in DROPPED:
        html = F.regexp_replace(html, pattern, _CUT)
    return html


def _lines(marked: Column) -> Column:
    for entity, char in ENTITIES:
        marked = F.replace(marked, F.lit(entity), F.lit(char))
    trimmed = F.transform(
        F.split(marked, _CUT), lambda s: F.regexp_replace(s, f"^{_BLANK}|{_BLANK}$", "")
    )
    return F.array_join(F.filter(trimmed, lambda s: s != ""), "\n")


def _is_plain(html: Column, marked: Column) -> Column:
    """Whether the patterns read this page exactly as a parser would."""
    bare = marked
    for entity, _ in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(""))
    # An opener without a block of its own: left open, in a comment, or in a string.
    stray = F.lit(False)
    for opener, block in zip((r"(?i)<script\b", r"(?i)<style\b", "<!--"), DROPPED):
        stray = stray | (F.regexp_count(html, F.lit(opener)) != F.regexp_count(html, F.lit(block)))
    odd_markup = (
        stray
        | html.contains(_CUT)
        | html.rlike(r"""=\s*("[^"]*[<>][^"]*"|'[^']*[<>][^']*')""")
        | html.rlike(r"(?i)<![^-d]|<!-[^-]|<[?]|<textarea\b|<plaintext\b|<xmp\b|<noembed\b|<iframe\b")
    )
    return ~(odd_markup | bare.rlike(r"&[A-Za-z#]|<"))


def with_html_text(df: DataFrame, html: str, out: str = "text", error: str | None = None) -> DataFrame:
    """Add ``out``: text nodes without script and style, trimmed, one per line.

    A page that cannot be read has a null text, and its message in ``error`` if that is named.

    Built-in functions do the work for ordinary pages. Pages with markup the
    patterns cannot read go through :func:`text_spans`.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    return (
        df.withColumn("_html_marked", _marked(page))
        .withColumn("_html_plain", _is_plain(page, F.col("_html_marked")))
        .withColumn("_html_parsed", _parse(F.when(~F.col("_html_plain"), page)))
        .withColumn(out, F.when(F.col("_html_plain"), _lines(F.col("_html_marked"))).otherwise(F.col("_html_parsed.text")))
        .withColumns({error: F.col("_html_parsed.error")} if error else {})
        .drop("_html_marked", "_html_plain", "_html_parsed")
    )
