"""Shared helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (float sums depend on partitioning)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)
