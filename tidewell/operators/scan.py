"""Passes over whole series in order of date, block by block, with what a series carries from one block to its next.

The rows of a key come to one task, but never into memory together: a pass holds one Arrow batch and what the open series carries (sums, coefficients, a sorted list), so a series may be
as long as it likes. Many series share a batch, and most of the work on them is on whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Of a block and the places at which its series begin (the first may go on from the block before; then `carried` is what that block returned): the result and what the last series carries.
Block = Callable[[pd.DataFrame, np.ndarray, object], tuple[pd.DataFrame, object]]


def in_order(df: DataFrame, keys: Sequence[str] = ("location",), date: str = "date") -> DataFrame:
    """df with the rows of a key in one partition and in order of date. Windows over (keys, date) that follow need no further shuffle or sort."""
    return df.repartition(*keys).sortWithinPartitions(*keys, date)


def scan(df: DataFrame, block: Block, schema: str, keys: Sequence[str] = ("location",), date: str = "date") -> DataFrame:
    """`block` applied to all rows of df, which is in_order(). Rows that are out of order are an error."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried, last, day = None, None, None
        for b in batches:
            if not len(b):
                continue
            own = b[keys].astype(object).where(b[keys].notna(), None)
            new = np.ones(len(b), bool)
            new[1:] = (own.iloc[1:].to_numpy() != own.iloc[:-1].to_numpy()).any(axis=1)
            days = b[date].to_numpy().astype("datetime64[D]")
            goes_on = last is not None and tuple(own.iloc[0]) == last
            back = (days[1:] < days[:-1])[~new[1:]].any() or (goes_on and days[0] < day)
            if back:
                raise ValueError("rows must come in order of date: give scan() what in_order() returns")
            out, carried = block(b, np.flatnonzero(new), carried if goes_on else None)
            last, day = tuple(own.iloc[-1]), days[-1]
            yield out

    return df.mapInPandas(run, schema)


def running(values: np.ndarray, starts: np.ndarray, carried: np.ndarray | None) -> np.ndarray:
    """Running sums of the rows of `values` in each series; the first goes on from `carried`."""
    out = np.empty_like(values)
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(values)), strict=True)):
        np.cumsum(values[a:b], axis=0, out=out[a:b])
        if k == 0 and carried is not None:
            out[a:b] += carried
    return out


def before(values: np.ndarray, starts: np.ndarray, carried: np.ndarray | None, none: float = 0.0) -> np.ndarray:
    """The row before in the same series: `none` for its first; for the first of a series that goes on, `carried`."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = none
    if carried is not None:
        out[0] = carried
    return out


def numbers(column: pd.Series) -> np.ndarray:
    """A column of arrays of the same length, as a matrix; nulls are NaN, a null array is a row of them."""
    width = max((len(x) for x in column if x is not None), default=0)
    empty = [np.nan] * width
    return np.array([empty if x is None else x for x in column], float).reshape(len(column), width)
