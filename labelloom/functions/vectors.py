"""Vector expressions. Heavy products run as numpy on Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Row-wise dot product of two array columns; null when either side is null."""
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        left = np.stack(a[known].to_numpy()).astype("float64")
        right = np.stack(b[known].to_numpy()).astype("float64")
        out[known] = np.einsum("ij,ij->i", left, right)
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit(a: pd.Series) -> pd.Series:
    """Each vector scaled to length 1; a zero vector stays zero."""
    out = []
    for v in a:
        if v is None:
            out.append(None)
            continue
        v = np.asarray(v, dtype="float64")
        length = np.sqrt(v @ v)
        out.append(v / length if length > 0 else v)
    return pd.Series(out)


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean per group; partial sums combine on the map side."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(dense)).alias(out))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
