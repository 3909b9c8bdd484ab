"""Small column functions used by logs and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.fixed_values import REVIEW_THRESHOLD


def rounded(confidence: Column) -> Column:
    return F.round(confidence, 4)


def review_flag(confidence: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    """Strictly below the threshold, on the unrounded value."""
    return confidence < F.lit(float(threshold))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "medium").otherwise("low")


def _utc(ts: Column, between: str) -> Column:
    """Read off the seconds since 1970, so the session time zone plays no part. A time stored
    without zone is read in the session's zone."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.when(ts.isNotNull(), F.concat(day, F.lit(between), clock, F.lit("Z")))


def utc_stamp(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` in UTC, in any session time zone."""
    return _utc(ts, "T")


def utc_stamp_spaced(ts: Column) -> Column:
    return _utc(ts, " ")


def csv_field(value: Column) -> Column:
    """Quote only a value with a comma, a quote or a newline; null becomes empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])
