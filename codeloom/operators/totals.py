"""Several one-row summaries put next to each other without a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*summaries: DataFrame) -> DataFrame:
    """One row with the columns of all one-row inputs, whose names must differ."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
