"""Shapes of points, weighted points and labels, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", T.ArrayType(T.FloatType()))])
WEIGHTED = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
LABEL = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.LongType())])


def has_bad_value(features: Column) -> Column:
    """True if a value is NaN, infinite or null."""
    return F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def checked_points(points: DataFrame, dims: int | None = None, on_invalid: str = "fail", features: str = "features") -> DataFrame:
    """Rows with a null vector, a value that isn't finite or another length fail the query, or are dropped."""
    good = F.col(features).isNotNull() & ~has_bad_value(F.col(features))
    if dims is not None:
        good = good & (F.size(features) == dims)
    good = F.coalesce(good, F.lit(False))
    if on_invalid == "drop":
        return points.filter(good)
    if on_invalid != "fail":
        raise ValueError("on_invalid is 'fail' or 'drop'")
    return points.filter(F.assert_true(good, F.lit("a point is null, not finite or of another length")).isNull())
