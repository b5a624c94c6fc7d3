import datetime

import pytest

from corpusql.functions import standardize as sd

NUMBERS = [
    ("$50,000", 50000.0), ("1M", 1e6), ("1.5 million", 1.5e6), ("28.3B", 28.3e9), ("2 thousand", 2000.0),
    ("3 billion dollars", 3e9), ("15%", 15.0), ("-5", -5.0), ("-5M", -5e6), ("USD 5M", 5e6), ("USD 500", None),
    ("1MM BBL", None), ("(500)", None), ("~12,000", None), ("1.2.3", None), ("1.5bn", None), ("1e5", 1e5),
    ("inf", None), ("nan", None), ("N/A", None), ("none", None), ("-", None), (" ", None), (None, None),
    ("€1.000.5", None), ("  £ 7 ", 7.0), ("$10-15M", 15e6), ("USD -5M", -5e6), ("+3k", 3000.0), ("1d", None),
    ("2 trillion", 2e12), ("4 TRILLION", 4e12), ("₹1,00,000", 100000.0), ("1_000", None), (".5", 0.5), ("5.", 5.0),
]


def test_real(column):
    assert column([v for v, _ in NUMBERS], sd.real) == [w for _, w in NUMBERS]


@pytest.mark.parametrize("value,want", [("3.9", 3), ("-3.9", -3), ("28.3B", 28300000000), ("inf", None), ("1e30", None)])
def test_integer_truncates_toward_zero(column, value, want):
    assert column([value], sd.integer) == [want]


def test_boolean(column):
    true = ["Yes", "y", "1", "on", "Enabled", "available", "included", " TRUE "]
    false = ["No", "n", "0", "off", "disabled", "unavailable", "not included", "False"]
    assert column(true, sd.boolean) == [True] * len(true)
    assert column(false, sd.boolean) == [False] * len(false)
    assert column(["maybe", None, "n/a"], sd.boolean) == [None] * 3


DATES = [
    ("2024-01-15", True), ("2024-01-15T10:30", True), ("Closed 2024-01-15.", True), ("01/15/2024", True),
    ("01-15-2024", True), ("15 January 2024", True), ("January 15, 2024", True), ("15 january 2024", True),
    ("Due January 15 2024 at noon", True), ("Jan 15, 2024", False), ("15/01/2024", False), ("02/30/2024", False),
    ("2024-13-45", False), ("soon", False), ("0000-01-01", False),
]


def test_dates(column):
    values = [v for v, _ in DATES]
    assert column(values, sd.date_text) == ["2024-01-15" if ok else v for v, ok in DATES]
    day = datetime.date(2024, 1, 15)
    assert column(values, sd.date) == [day if ok else None for _, ok in DATES]


def test_a_failed_pattern_falls_through_to_the_next(column):
    assert column(["2024-13-45 or 01/15/2024"], sd.date_text) == ["2024-01-15"]


def test_text(column):
    assert column(['  "Acme   Corp"  ', "'x'", "a  b", "N/A", '"'], sd.text) == ["Acme Corp", "x", "a b", None, ""]


def test_null_tokens(column):
    assert column(["null", " None ", "N/A", "na", "-", "", None, "nay"], sd.null_token) == [None] * 7 + ["nay"]


@pytest.mark.parametrize("kind", ["TEXT", "DATE", "JSON", "UNKNOWN"])
def test_text_standardisers_are_idempotent(column, kind):
    values = ["  a  b ", "January 15, 2024", "x", "'q'", None]
    once = column(values, lambda c: sd.standardize(c, kind))
    assert column(once, lambda c: sd.standardize(c, kind)) == once


def test_numbers_are_idempotent(column):
    once = column([v for v, _ in NUMBERS], lambda c: sd.real(c).cast("string"))
    assert column(once, lambda c: sd.real(c).cast("string")) == once


def test_numbers_and_dates_in_one_look(spark):
    """Plain numbers come first and dates need a sign inside; neither changes what is read."""
    from pyspark.sql import functions as F

    values = ["12.5", "-1e3", "1.5k", "-2 million", "7 thousand units", "3 bananas", "1.2.3", ".", "12345", "1998-02-03", "on 02/03/1998 x",
              "3 March 1998", "March 3, 1998", "19980203", "31/12", "1998-13-45", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in rows.select(sd.real(F.col("v")), sd.iso_date(F.col("v"))).collect()]
    assert [r for r, _ in got][:9] == [12.5, -1000.0, 1500.0, -2e6, 7000.0, None, None, None, 12345.0]
    assert [d for _, d in got][8:] == [None, "1998-02-03", "1998-02-03", "1998-03-03", "1998-03-03", None, None, None, None]
