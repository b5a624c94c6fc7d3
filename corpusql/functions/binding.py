"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Writing ``body(value)`` directly copies the whole expression to each place
    that uses it; a one-element ``transform`` binds it to a lambda variable.
    """
    return F.transform(F.array(value), body)[0]
