"""Rows of a table carried through an operator as one struct, whatever the names of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed_row(docs: DataFrame) -> Column:
    """All columns as a struct of c0, c1, ... in order."""
    return F.struct(*(quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))


def unpacked_row(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``docs`` again, from such a struct."""
    return [F.col(row)[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]
