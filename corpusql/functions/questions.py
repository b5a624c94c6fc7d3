"""Rules for question classes and for read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUESTION_CLASSES = (
    "count", "aggregation", "filter", "group_by", "join", "temporal", "ranking", "simple",
)

# Ordered rules: the first that matches names the class.
CLASS_RULES = (
    ("ranking", r"(?i)\b(?:top|bottom|highest|lowest|largest|smallest|most|least)\b"),
    ("group_by", r"(?i)\b(?:by|per|each|distribution)\b"),
    ("count", r"(?i)\b(?:how many|count|number of)\b"),
    ("aggregation", r"(?i)\b(?:average|mean|total|sum|maximum|minimum|max|min)\b"),
    ("temporal", r"(?i)\b(?:month|quarter|year|monthly|quarterly|yearly|trend|last|since)\b"),
    ("join", r"(?i)\b(?:together with|along with|joined with|related to)\b"),
    ("filter", r"(?i)\b(?:above|below|over|under|greater|less|more than|between|where|compare)\b"),
)
JOIN_RULE = r"(?i)\b(?:with|and their|along with|joined with|related to)\b"
DEFAULT_CLASS, DEFAULT_COMPLEXITY = "simple", "medium"
DEFAULT_CONFIDENCE, RULE_CONFIDENCE = 0.5, 0.8

# Words that change data.
UNSAFE_WORDS = (
    "DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE",
)
UNSAFE_RULE = rf"(?i)\b(?:{'|'.join(UNSAFE_WORDS)})\b"
READ_RULE = r"(?i)\A\s*(?:SELECT|WITH)"


def question_class(question: Column) -> Column:
    chosen = None
    for name, rule in CLASS_RULES:
        hit = question.rlike(rule)
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    return chosen.otherwise(F.lit(DEFAULT_CLASS))


def matched_rules(question: Column) -> Column:
    hits = [F.when(question.rlike(rule), 1).otherwise(0) for _, rule in CLASS_RULES]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def complexity(question: Column) -> Column:
    """Medium when no rule applies; otherwise by the number of rules that do."""
    n = matched_rules(question)
    return (
        F.when(n == 0, F.lit(DEFAULT_COMPLEXITY))
        .when(n == 1, F.lit("simple"))
        .when(n == 2, F.lit("medium"))
        .otherwise(F.lit("complex"))
    )


def requires_join(question: Column) -> Column:
    return question.rlike(JOIN_RULE)


def confidence(question: Column) -> Column:
    return F.when(matched_rules(question) > 0, F.lit(RULE_CONFIDENCE)).otherwise(
        F.lit(DEFAULT_CONFIDENCE)
    )


def is_safe_text(statement: str) -> bool:
    """The same rule for one statement at hand."""
    return bool(re.match(READ_RULE, statement)) and not re.search(UNSAFE_RULE, statement)


def is_safe_sql(statement: Column) -> Column:
    """Read-only: starts with SELECT or WITH and holds no data-changing word."""
    return statement.rlike(READ_RULE) & ~statement.rlike(UNSAFE_RULE)
