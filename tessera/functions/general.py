"""Small helpers on the driver, and dates as column expressions."""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Any) -> Any:
    """The item of an array of one, anything else as it is."""
    try:
        return x.item()
    except (ValueError, AttributeError):
        return x


def select(objects: list | dict, fn: Callable[[Any], bool], unlist: bool = True, first: bool = False) -> Any:
    """The objects for which fn holds: of a list that leaves one, that one; with first, the first or None."""
    if isinstance(objects, dict):
        found: Any = {k: v for k, v in objects.items() if fn(v)}
    else:
        found = [x for x in objects if fn(x)]
    if first:
        return next(iter(found.values() if isinstance(found, dict) else found), None)
    return found[0] if unlist and isinstance(found, list) and len(found) == 1 else found


def dict_product(d: dict[Any, Any]) -> Iterator[dict]:
    """A dictionary for each combination of the values."""
    return (dict(zip(d, values)) for values in itertools.product(*d.values()))


def array_chunks(array: np.ndarray, n: int, axis: int = 0, return_indices: bool = False) -> Iterator[Any]:
    """Consecutive parts of n along an axis, with their index if asked for."""
    if axis >= array.ndim:
        raise ValueError(f"axis {axis} is out of range for given array.")
    for at in range(0, array.shape[axis], n):
        index = [slice(None)] * array.ndim
        index[axis] = slice(at, at + n)
        yield (index, array[tuple(index)]) if return_indices else array[tuple(index)]


def str2date(string: str, fmt: str | None = None, tz: bool = False) -> datetime.datetime:
    """A date in a known or any usual format; with tz in UTC if it names no zone, without it its zone is dropped."""
    found = datetime.datetime.strptime(string, fmt) if fmt else pd.Timestamp(string).to_pydatetime()
    if tz:
        return found if found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)
    return found.replace(tzinfo=None)


#: Formats that parse_date() tries in turn.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "dd-MMM-yyyy", "dd/MM/yyyy")


def parse_date(column: Column, fmt: str | None = None) -> Column:
    """The timestamp (without a zone) of a string in one of the formats; null if in none."""
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in ((fmt,) if fmt else DATE_FORMATS)]).cast("timestamp_ntz")


def expand_kernel(kernel: np.ndarray, kernel_dims: tuple[str, ...], dims: tuple[str, ...]) -> np.ndarray:
    """A kernel over some dims as one over more, 1 wide along the others."""
    if not set(kernel_dims) <= set(dims):
        raise ValueError("dims must be a superset of kernel_dims")
    if kernel.ndim != len(kernel_dims):
        raise ValueError("the kernel doesn't have as many axes as kernel_dims")
    order = sorted(range(kernel.ndim), key=lambda k: dims.index(kernel_dims[k]))
    sizes = dict(zip(kernel_dims, kernel.shape))
    return kernel.transpose(order).reshape([sizes.get(d, 1) for d in dims])
