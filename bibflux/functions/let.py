"""Names for intermediate values inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row.

    An expression that is used inside a lambda function is otherwise computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
