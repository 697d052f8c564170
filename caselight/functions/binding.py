"""Binding of a value in a column expression; without the imports of text functions, for workers that need only this."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, f) -> Column:
    """f of a column that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))
