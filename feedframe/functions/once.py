"""Columns worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns so that each is evaluated once per row.

    The optimizer moves a filter below the projection it refers to and writes the whole
    expression out again there, which for a JSON or XML parse means parsing twice, and for
    expressions built on each other grows the plan without bound. The output of a
    generator is not written out like that, so the values pass through one of one row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline_outer(F.array(row)))


def exploded(df: DataFrame, array: Column, *names: str) -> DataFrame:
    """One row per array item, as ``(position, item)`` or ``(item,)``; empty arrays give none.

    The outer form with a filter after it, because the optimizer checks the array of the
    plain form in a filter of its own and so works it out twice.
    """
    generator = F.posexplode_outer(array) if len(names) == 2 else F.explode_outer(array)
    rows = df.select("*", generator.alias(*names))
    return rows.where(F.col(names[0]).isNotNull())
