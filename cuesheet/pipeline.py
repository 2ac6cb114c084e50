"""Pipelines by configuration: names of registered transforms, with arguments, composed into one plan."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Make a function (DataFrame, **arguments) -> DataFrame known by a name; a name is given once."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered already")
        _REGISTRY[name] = f
        return f

    return add


def known() -> list[str]:
    return sorted(_REGISTRY)


def compose(config: list[str | tuple[str, dict]], **shared) -> Callable[[DataFrame], DataFrame]:
    """One transform from a list of names, or (name, arguments). Shared arguments go to the functions that take them.

    Nothing runs here: Catalyst sees the whole plan and fuses filters and projections over the steps.
    """
    steps = []
    for entry in config:
        name, arguments = (entry, {}) if isinstance(entry, str) else entry
        if name not in _REGISTRY:
            raise KeyError(f"no transform {name!r}; known: {', '.join(known())}")
        f = _REGISTRY[name]
        takes = inspect.signature(f).parameters
        steps.append((f, {k: v for k, v in shared.items() if k in takes} | arguments))
    return lambda df: reduce(lambda d, s: s[0](d, **s[1]), steps, df)
