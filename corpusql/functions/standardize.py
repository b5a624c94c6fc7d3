"""Value standardisation: free text to typed, comparable values.

Every function takes and returns a Column, so a whole entity table is
standardised by one ``select`` inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusql.functions.binding import let

FIELD_TYPES = ("TEXT", "INTEGER", "REAL", "DATE", "BOOLEAN", "JSON")

# Spellings of "no value".
NULL_TOKENS = ("", "null", "none", "n/a", "na", "-")

# Accepted spellings of true and false.
TRUE_WORDS = ("true", "yes", "y", "1", "on", "enabled", "available", "included")
FALSE_WORDS = ("false", "no", "n", "0", "off", "disabled", "unavailable", "not included")

# Number scales.
SUFFIX_SCALE = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
WORD_SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}

# Forms of scaled numbers.
SUFFIXED = r"([0-9.]+)\s*([kKmMbBtT])(?:illion)?\z"
WORDED = r"(?i)([0-9.]+)\s*(thousand|million|billion|trillion)"
PLAIN_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# The same characters as text, for trimming without a regular expression.
SPACES = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
NUMBER_NOISE = "$€£¥₹%,"

# Date forms in the order they are tried: where to look, and how to read it.
WORD = r"[\p{L}\p{N}_]+"
# Date forms, in the order they are tried.
DATE_FORMS = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "MM-dd-yyyy"),
    (rf"\d{{1,2}}\s+{WORD}\s+\d{{4}}", "d MMMM yyyy"),
    (rf"{WORD}\s+\d{{1,2}},?\s+\d{{4}}", "MMMM d yyyy"),
)


def _trim(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def _scale(unit: Column, table: Mapping[str, float]) -> Column:
    chosen = None
    for name, factor in table.items():
        case = F.lower(unit) == name
        chosen = F.when(case, F.lit(factor)) if chosen is None else chosen.when(case, F.lit(factor))
    return chosen


def null_token(value: Column) -> Column:
    """Trimmed text, or NULL when it only says that there is no value."""
    return let(_trim(value), lambda t: F.when(~F.lower(t).isin(*NULL_TOKENS), t))


def _plain_double(text: Column) -> Column:
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def _scaled(text: Column, pattern: str, table: Mapping[str, float]) -> Column:
    """Number times unit. A minus directly before the number is kept."""
    digits = F.regexp_extract(text, pattern, 1)
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    negative = text.rlike(rf"{flags}(?:\A|\s)-\s*{bare}")
    amount = _plain_double(digits) * _scale(F.regexp_extract(text, pattern, 2), table)
    return F.when(negative, -amount).otherwise(amount)


def real(value: Column) -> Column:
    # A plain number has neither a suffix nor a word, and is by far the most frequent form.
    return let(
        _trim(F.translate(null_token(value), NUMBER_NOISE, "")),
        lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))
        .when(t.rlike(SUFFIXED), _scaled(t, SUFFIXED, SUFFIX_SCALE))
        .when(t.rlike(WORDED), _scaled(t, WORDED, WORD_SCALE)),
    )


def integer(value: Column) -> Column:
    """Truncates toward zero; NULL when the number does not fit 64 bits."""
    return real(value).try_cast("bigint")


def boolean(value: Column) -> Column:
    return let(
        F.lower(null_token(value)),
        lambda w: F.when(w.isin(*TRUE_WORDS), F.lit(True)).when(w.isin(*FALSE_WORDS), F.lit(False)),
    )


def _read_date(text: Column, pattern: str, form: str) -> Column:
    """The first match of ``pattern`` as a date; NULL when it is no real date."""
    found = F.regexp_extract(text, pattern, 0)
    if "MMMM" in form:
        found = F.regexp_replace(found, r"[\s,]+", " ")
    parsed = let(found, lambda m: F.when(m != "", F.try_to_date(m, form)))
    return let(parsed, lambda d: F.when(F.year(d) > 0, d))


def date(value: Column) -> Column:
    """The first accepted form that holds a real date; otherwise NULL."""
    # Every form has one of these signs inside; a value without them is not looked through form by form.
    return let(
        null_token(value),
        lambda t: F.when(t.rlike(r"[-/\s]"), F.coalesce(*[_read_date(t, *form) for form in DATE_FORMS])),
    )


def iso_date(value: Column) -> Column:
    return F.date_format(date(value), "yyyy-MM-dd")


def date_text(value: Column) -> Column:
    """ISO text where a date is found, otherwise the trimmed input."""
    return let(null_token(value), lambda t: F.coalesce(iso_date(t), t))


def text(value: Column) -> Column:
    """White space collapsed, then quotes at both ends removed."""
    collapsed = F.trim(F.regexp_replace(value, UNICODE_SPACE, " "))
    return let(
        collapsed,
        lambda t: F.when(
            ~F.lower(t).isin(*NULL_TOKENS), F.btrim(t, F.lit("\"'"))
        ),
    )


_BY_TYPE = {"INTEGER": integer, "REAL": real, "BOOLEAN": boolean, "DATE": date_text}


def standardize(value: Column, field_type: str) -> Column:
    """Dispatch on the declared type; unknown types are treated as text."""
    return _BY_TYPE.get(field_type, text)(value)
