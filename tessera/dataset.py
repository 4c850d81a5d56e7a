"""Several cubes as one dataset, for variables that don't all have the same dims."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .cube import Cube


@dataclass(frozen=True)
class Dataset:
    """Cubes whose variables have different names; dims of one name have one size."""

    cubes: tuple[Cube, ...]

    def __post_init__(self) -> None:
        names = [v for c in self.cubes for v in c.variables]
        twice = sorted({v for v in names if names.count(v) > 1})
        if twice:
            raise ValueError(f"variables of several cubes: {', '.join(twice)}")
        for d in {d for c in self.cubes for d in c.dims}:
            if len({c.dims[d] for c in self.cubes if d in c.dims}) > 1:
                raise ValueError(f"{d} has different sizes")

    @classmethod
    def of(cls, *cubes: Cube) -> Dataset:
        return cls(tuple(cubes))

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(v for c in self.cubes for v in c.variables)

    @property
    def dims(self) -> dict[str, int]:
        return {d: n for c in self.cubes for d, n in c.dims.items()}

    def __getitem__(self, variable: str) -> Cube:
        for c in self.cubes:
            if variable in c.variables:
                return c.select(variable)
        raise KeyError(variable)

    def variables_with(self, dims: Sequence[str], invert: bool = False) -> list[str]:
        """The variables that have all these dims; with invert, those that lack one."""
        return [v for c in self.cubes for v in c.variables if (set(dims) <= set(c.dims)) != invert]

    def map(self, fn: Callable[[Cube], Cube], dims: Sequence[str] = ()) -> Dataset:
        """fn over the cubes that have the dims; the others pass through. If none has them there is nothing to map."""
        if not any(set(dims) <= set(c.dims) for c in self.cubes):
            raise ValueError(f"no variable has the dims {', '.join(dims)}")
        return Dataset(tuple(fn(c) if set(dims) <= set(c.dims) else c for c in self.cubes))

    def merged(self) -> Cube:
        """One cube over all dims: variables that lack some are the same along these, by one equi-join for each cube."""
        widest = max(self.cubes, key=lambda c: len(c.dims))
        if any(not set(c.dims) <= set(widest.dims) for c in self.cubes):
            raise ValueError("no cube has the dims of all others")
        df, names = widest.df, list(widest.variables)
        for c in self.cubes:
            if c is not widest:
                df = df.join(c.df.select(*c.dims, *c.variables), list(c.dims), "left") if c.dims else df.crossJoin(c.df.select(*c.variables).limit(1))  # no dims: one row
                names += c.variables
        return widest.with_df(df.select(*widest.dims, *names), names)
