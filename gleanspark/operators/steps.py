"""Steps of a plan that must not be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once.

    Filters on a projection's columns are pushed below it by writing the columns' expressions out, and where these
    build on each other by arrays and folds the expression grows beyond all bounds. They come from a generator of
    one row instead, which neither filters nor projections are merged with.
    """
    return df.select("*", F.stack(F.lit(1), *columns.values()).alias(*columns))
