"""Tokens, sentences, patterns and redaction as column expressions.

Character classes are spelled out because ``\\s`` and ``\\w`` differ between
regex engines; results must not depend on the engine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"
NON_SPACE = r"[^ \t\n\x0B\f\r]"

# A token keeps the white space before it (and, for the last one, behind it), so
# joining a run of tokens gives back the exact text of that run.
TOKEN = rf"({SPACE}*{NON_SPACE}+(?:{SPACE}+\z)?)"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+"

# One rule for ``Label: value`` lines, for Java and Python alike: a label starts with a letter.
LABEL_LINE = r"^[ \t]*[^\W\d_][\w ]*:(?!//)[ \t]*[^ \t\n\r][^\n\r]*"

# Patterns of the basic entity finder.
ENTITY_PATTERNS = {
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "dates": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b",
    "amounts": r"\$[\d,]+(?:\.\d{2})?",
}

# Redaction patterns and their placeholders.
REDACTIONS = {
    r"\d{3}-\d{2}-\d{4}": "[SSN]",
    r"\d{16}": "[CARD]",
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_SPACE}+")), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def find_entities(text: Column, kind: str, limit: int | None = None) -> Column:
    """Distinct matches of one pattern in sorted order; NULL when there is none."""
    found = F.array_sort(
        F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), 0))
    )
    if limit is not None:
        found = F.slice(found, 1, limit)
    return F.when(F.size(found) > 0, found)


def first_match(text: Column, pattern: str, group: int = 1, max_chars: int | None = None) -> Column:
    """First match of a labelled pattern; NULL when the pattern is absent."""
    value = strip(F.regexp_extract(text, pattern, group))
    if max_chars is not None:
        value = F.substring(value, 1, max_chars)
    return F.nullif(value, F.lit(""))


def redact(text: Column, rules: Mapping[str, str] = REDACTIONS) -> Column:
    for pattern, placeholder in rules.items():
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation dropped, white space collapsed: for comparing answers."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s.%-]", " ")
    plain = F.regexp_replace(plain, r"[.]+(?=\s|$)", " ")
    return strip(F.regexp_replace(plain, rf"{SPACE}+", " "))
