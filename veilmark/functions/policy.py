"""Labelling rules as column functions: stamps, personal data, floors, masking.

All patterns avoid look-around and back-references, and spell out character
classes, so that other SQL engines accept and read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"(^|[^\p{L}\p{N}_])"
_END = r"([^\p{L}\p{N}_]|$)"


def _phrase(body: str) -> str:
    return "(?i)" + _EDGE + "(" + body + ")" + _END


# Most specific first: "highly confidential" also contains "confidential".
STAMPS = [
    (5, _phrase("(personal|private)( and)? highly confidential")),
    (4, _phrase("highly confidential")),
    (3, _phrase("(personal|private)( and)? confidential")),
    (2, _phrase("confidential")),
    (1, _phrase("for official use only|fouo|internal use only")),
    (0, _phrase("for immediate release|approved for public distribution|cleared for public release")),
]

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9][0-9 ().-]{6,}[0-9]"
BORN = r"((?i:dob|date of birth|born on)[: ]{1,2})[0-9]{1,2}[ /.-][A-Za-z0-9]+[ /.-]([0-9]{4})"
STAFF_ID = r"EMP-[0-9]+"
CUSTOMER_ID = r"CUS-[0-9]+"
MONEY = r"[€$£][1-9][0-9,.]*|[1-9][0-9,.]*[KMB]? ?(?:EUR|USD|GBP)"

# Each pattern needs one of these pieces in the lower-cased text. Looking for them
# first is many times cheaper than the pattern, and most texts have none.
HINTS = {
    "pii_email": ["@"],
    "pii_phone": ["+"],
    "pii_dob": ["dob", "of birth", "born on"],
    "pii_id": ["emp-", "cus-"],
    "pii_pay": ["salary", "compensation", "payroll", "bonus"],
    "pii_health": ["medical record", "health record", "diagnosis", "disability", "occupational health"],
    "pii_name": ["name:", "requestor:", "employee:", "individual:"],
}
STAMP_HINTS = {
    5: ["confidential"],
    4: ["confidential"],
    3: ["confidential"],
    2: ["confidential"],
    1: ["official use", "fouo", "internal use"],
    0: ["release", "distribution"],
}

PERSONAL = {
    "pii_email": EMAIL,
    "pii_phone": PHONE,
    "pii_dob": r"(?i)(dob|dates? of birth|born on)",
    "pii_id": r"(EMP|CUS)-[0-9]+",
    "pii_pay": r"(?i)(salary|compensation|payroll|bonus)",
    "pii_health": r"(?i)(medical record|health record|diagnosis|disability|occupational health)",
    "pii_name": r"(Name|Requestor|Employee|Named individual): ?\p{Lu}\p{L}+ \p{Lu}\p{L}+",
}


def _hinted(text: Column, hints: list[str]) -> Column:
    low, hit = F.lower(text), None
    for piece in hints:
        found = low.contains(piece)
        hit = found if hit is None else hit | found
    return hit


def _matches(text: Column, pattern: str, hints: list[str]) -> Column:
    return _hinted(text, hints) & text.rlike(pattern)


def stamp(text: Column) -> Column:
    """Index of the level stamped on the text; null when there is none."""
    chain = None
    for idx, pattern in STAMPS:
        hit = _matches(text, pattern, STAMP_HINTS[idx])
        chain = F.when(hit, F.lit(idx)) if chain is None else chain.when(hit, F.lit(idx))
    return chain


def personal_counts(text: Column) -> list[Column]:
    """One hit count per kind of personal data."""
    return [
        F.when(_hinted(text, HINTS[name]), F.regexp_count(text, F.lit(pattern)))
        .otherwise(F.lit(0))
        .cast("long")
        .alias(name)
        for name, pattern in PERSONAL.items()
    ]


def has_personal_data(text: Column) -> Column:
    found = F.lit(False)
    for name, pattern in PERSONAL.items():
        found = found | _matches(text, pattern, HINTS[name])
    return F.coalesce(found, F.lit(False))


def personal_floor(level: Column, personal: Column) -> Column:
    """Personal data lifts FOUO and CONFIDENTIAL to PERSONAL_CONFIDENTIAL and
    HIGHLY_CONFIDENTIAL to its personal form; it never makes CONFIDENTIAL highly so."""
    return (
        F.when(personal & level.isin(1, 2), F.lit(3))
        .when(personal & (level == 4), F.lit(5))
        .otherwise(level)
    )


def needs_review(level: Column, personal: Column) -> Column:
    """Public material with personal data: no rule says what it is, so a person decides."""
    return F.coalesce(personal & (level == 0), F.lit(False))


def stamp_or_content(stamped: Column, content: Column, hits: Column, enough: int = 2) -> Column:
    """The stamp is the starting point; clearly highly confidential content beats a
    CONFIDENTIAL stamp; without a stamp the content decides."""
    return F.coalesce(
        F.when((stamped == 2) & (content == 4) & (hits >= enough), F.lit(4)), stamped, content
    )


def _mask_money(text: Column) -> Column:
    """Keep the first digit of every amount, turn the others into zeros."""
    amounts = F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))

    def rounded(m: Column) -> Column:
        keep = F.when(m.rlike("^[0-9]"), F.lit(1)).otherwise(F.lit(2))
        tail = F.substr(m, keep + 1)
        return F.concat(F.substr(m, F.lit(1), keep), F.translate(tail, "123456789", "000000000"))

    pieces = F.zip_with(
        F.split(text, MONEY, -1),
        F.concat(F.transform(amounts, rounded), F.array(F.lit(""))),
        lambda between, amount: F.concat(between, amount),
    )
    return F.array_join(pieces, "")


MASKS = [
    (["@"], EMAIL, "name@organisation.com"),
    (["+"], PHONE, "+XX XXX XXX XXXX"),
    (["emp-"], STAFF_ID, "EMP-XXXXX"),
    (["cus-"], CUSTOMER_ID, "CUS-XXXXX"),
    (["dob", "date of birth", "born on"], BORN, "$1XX XXX $2"),
]
MONEY_HINTS = ["€", "$", "£", "eur", "usd", "gbp"]


def with_anonymised(df: DataFrame, text: str) -> DataFrame:
    """Mask e-mail addresses, phone numbers, ids, birth dates and amounts.

    One step per kind; a step that has nothing to do passes the text on.
    """
    t = F.col(text)
    for hints, pattern, mask in MASKS:
        df = df.withColumn(
            text, F.when(_hinted(t, hints), F.regexp_replace(t, pattern, mask)).otherwise(t)
        )
    return df.withColumn(text, F.when(_hinted(t, MONEY_HINTS), _mask_money(t)).otherwise(t))
