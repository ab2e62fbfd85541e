"""Binding of values inside expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda over a one-element array binds the value; without it the optimizer may inline the
    expression into an inner lambda, where it would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
