"""Python functions of expressions as Arrow batch functions that compute each distinct argument of a batch once."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(f: Callable, returns: str) -> Callable[..., Column]:
    """f over columns; nulls come as None, results may be None, dicts for structs, or lists."""

    def run(*columns: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for key in zip(*columns):
            key = tuple(None if x is None or x is pd.NA or x != x else x for x in key)
            if key not in known:
                known[key] = f(*key)
            out.append(known[key])
        return pd.Series(out, dtype=object)

    if returns.startswith("struct<"):

        def rows(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(run(*columns).tolist())

        return F.pandas_udf(rows, returns)
    return F.pandas_udf(run, returns)
