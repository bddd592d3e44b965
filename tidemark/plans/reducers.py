"""A registry of named transforms over tables: what a stored procedure is in a keyed store is here a function from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

REDUCERS: dict[str, Callable[..., DataFrame]] = {}


def reducer(name: str | None = None):
    """Registers a function under a name; a second one of that name is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or f.__name__
        if key in REDUCERS:
            raise ValueError(f"{key} is registered already")
        REDUCERS[key] = f
        return f

    return add


def call(name: str, *frames: DataFrame, **args) -> DataFrame:
    """Runs a registered transform; it returns the new rows or deltas and changes nothing in place."""
    if name not in REDUCERS:
        raise KeyError(f"no reducer {name!r}")
    return REDUCERS[name](*frames, **args)
