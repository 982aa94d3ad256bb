"""Evaluate a value once per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(*values: Column, body: Callable[..., Column]) -> Column:
    """``body`` of the values, each evaluated once.

    Catalyst folds a projection into the lambdas that use its columns, which would evaluate an
    expensive column once per array element. A value bound to a lambda variable stays evaluated.
    """
    first, *rest = values
    inner = (lambda x: body(x)) if not rest else (lambda x: let(*rest, body=lambda *xs: body(x, *xs)))
    return F.get(F.transform(F.array(first), inner), F.lit(0))


def unpacked(df: DataFrame, keys: Sequence[str], array: Column | str, *names: str) -> DataFrame:
    """The keys and one row per array element, named ``(position, element)`` or ``(element,)``.

    A plain explode makes Catalyst infer a filter on the array's size, which evaluates an array that
    is computed in the same stage up to three times. Elements must not be null.
    """
    generator = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    return df.select(*keys, generator.alias(*names)).where(F.col(names[-1]).isNotNull())
