"""Distances as SQL functions: ``znorm_dist``, ``mass`` and ``mpdist`` over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seriesloom.session import ship


def _scaled(x: str) -> str:
    """An array scaled to mean 0 and norm 1; a constant one to 0."""
    mean = f"(aggregate({x}, 0D, (s, v) -> s + v) / size({x}))"
    centred = f"transform(array({mean}), m -> transform({x}, v -> v - m))[0]"
    return f"transform(array({centred}), c -> transform(array(sqrt(aggregate(c, 0D, (s, v) -> s + v * v))), n -> transform(c, v -> if(array_max({x}) = array_min({x}), 0D, v / n)))[0])[0]"


def _distance(x: str, y: str) -> str:
    """z-normalised Euclidean distance: sqrt(w) between a constant array and another, 0 between two constant ones."""
    r = f"aggregate(zip_with({_scaled(x)}, {_scaled(y)}, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    flat = lambda a: f"array_max({a}) = array_min({a})"
    return f"if({flat(x)} AND {flat(y)}, 0D, if({flat(x)} OR {flat(y)}, sqrt(size({x})), sqrt(2D * size({x}) * greatest(0D, 1D - {r}))))"


def register(spark: SparkSession) -> None:
    """Make ``znorm_dist(x, y)``, ``mass(query, series)`` and ``mpdist(x, y, w, threshold)`` known to SQL in this session.

    The first two are SQL expressions; the third runs in Arrow batches.
    """
    arrays = "ARRAY<DOUBLE>"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION znorm_dist(x {arrays}, y {arrays}) RETURNS DOUBLE RETURN if(size(x) = size(y), {_distance('x', 'y')}, NULL)")
    each = f"transform(sequence(0, size(series) - size(query)), i -> transform(array(slice(series, i + 1, size(query))), p -> {_distance('query', 'p')})[0])"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mass(query {arrays}, series {arrays}) RETURNS {arrays} RETURN if(size(query) <= size(series), {each}, array())")
    ship(spark)

    @F.pandas_udf("double")
    def mpdist(x: pd.Series, y: pd.Series, w: pd.Series, threshold: pd.Series) -> pd.Series:
        from seriesloom.operators.mpdist import _pair

        return pd.Series([None if a is None or b is None else _pair(np.asarray(a, float), np.asarray(b, float), int(k), float(t)) for a, b, k, t in zip(x, y, w, threshold)], dtype=float)

    spark.udf.register("mpdist", mpdist)
