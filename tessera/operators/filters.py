"""Typed metadata filters with two-valued logic.

A predicate on a missing value is false, and so its negation is true; SQL's
third truth value never arises.  Filters compile to columns, so they are
applied before the search and reach the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"string": "string", "float": "float", "int": "bigint"}


class Filter:
    """A predicate over metadata columns; combine with &, | and ~."""

    def __init__(self, column: Column | None):
        self._column = column

    @property
    def trivial(self) -> bool:
        return self._column is None

    @property
    def column(self) -> Column:
        return F.lit(True) if self._column is None else self._column

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return Filter(~self.column)


#: The filter that every row passes.
EVERYTHING = Filter(None)


def _known(predicate: Column) -> Filter:
    return Filter(F.coalesce(predicate, F.lit(False)))


class Field:
    """A metadata column of kind 'string', 'float' or 'int'.

    Comparisons of int fields are exact; those of float fields are made in
    single precision.
    """

    def __init__(self, name: str, kind: str = "string"):
        self.name, self.kind = name, KINDS[kind]

    def _value(self) -> Column:
        return F.col(self.name).cast(self.kind)

    def _literal(self, value) -> Column:
        return F.lit(value).cast(self.kind)

    def __eq__(self, value) -> Filter:  # type: ignore[override]
        return _known(self._value() == self._literal(value))

    def __ne__(self, value) -> Filter:  # type: ignore[override]
        return ~(self == value)

    def __gt__(self, value) -> Filter:
        return _known(self._value() > self._literal(value))

    def __lt__(self, value) -> Filter:
        return _known(self._value() < self._literal(value))

    def one_of(self, values) -> Filter:
        return _known(self._value().isin([self._literal(v) for v in sorted(values)])) if values else Filter(F.lit(False))

    __hash__ = None  # type: ignore[assignment]


def all_of(*filters: Filter) -> Filter:
    """Every one holds; true if there are none."""
    real = [f for f in filters if not f.trivial]
    return Filter(reduce(and_, (f.column for f in real))) if real else EVERYTHING


def any_of(*filters: Filter) -> Filter:
    """At least one holds; false if there are none."""
    if any(f.trivial for f in filters):
        return EVERYTHING
    return Filter(reduce(or_, (f.column for f in filters))) if filters else Filter(F.lit(False))
