"""Algorithms as classes with a function front: cls(args).apply(cube) is name(cube, args)."""

from __future__ import annotations

import inspect
from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

from .cube import Cube


class Algorithm(ABC):
    @abstractmethod
    def apply(self, cube: Cube) -> Cube: ...

    def halo(self, dim: str) -> int:
        """Cells of neighbouring tiles that the algorithm reads along a dim."""
        return 0


def as_function(cls: type[Algorithm], name: str) -> Callable[..., Cube]:
    if not (inspect.isclass(cls) and issubclass(cls, Algorithm)):
        raise ValueError(f"{cls!r} is not an Algorithm")
    own = set(inspect.signature(cls.__init__).parameters) - {"self"}

    def call(cube: Cube, *args: Any, **kw: Any) -> Cube:
        return cls(*args, **{k: v for k, v in kw.items() if k in own}).apply(cube, **{k: v for k, v in kw.items() if k not in own})

    call.__name__, call.__doc__ = name, cls.__doc__
    return call
