"""Conjunctive optional filters and paged, totally ordered listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def identifier(name: str) -> str:
    """A column or table name that may stand in SQL text."""
    if not _NAME.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def filters(equal: dict, search: str | None, columns: tuple[str, ...], upper: tuple[str, ...] = ()) -> Column:
    """AND of equalities (None: no filter; `upper`: case ignored) and of an OR of
    case-insensitive substring searches."""
    out = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            out = out & (F.upper(F.col(name)) == str(value).upper() if name in upper else F.col(name) == value)
    if search:
        pattern = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        hit = F.lit(False)
        for name in columns:
            hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
        out = out & hit
    return out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page.  `order` should be total, or pages may overlap."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def without(df: DataFrame, column: str, keep: bool) -> DataFrame:
    """df with the column's values, or with NULLs of its type."""
    return df if keep else df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def explicit_order(df: DataFrame, key: str, reference: list, tie: Column) -> DataFrame:
    """Ordered by the place of the key in a reference list; others last."""
    place = F.array_position(F.array(*[F.lit(x) for x in reference]), F.col(key))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), tie)
