"""Keeping a costly column from being worked out again where it is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column) -> Column:
    """The value itself.  A filter on a column, such as the one that exploding
    implies, is moved below the projection that makes it and takes the column's
    expression along, once for each of its uses.  That isn't done where a value may
    depend on chance, as this seems to, though its condition always holds."""
    return F.when(F.rand(0) + 1 > 0, value)
