"""Evaluate a column once.

Catalyst inlines a projected column into its consumers when it is referenced once, even inside a
lambda, where it would run again for every element; it also copies it into filters it infers for
``explode``. A one-row ``explode`` ends that: what it produces is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row and never inlined further up."""
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.array(values)).alias("_held")).select(*keep, "_held.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it; also inside lambdas, where nothing
    else shares an expression that is written out twice."""
    return F.element_at(F.transform(F.array(value), body), 1)
