"""Functions that users add to the pattern language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

USER_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """A scalar function: from columns to a column. Built-in functions and pandas UDFs are such; names are compared without case."""
    USER_FUNCTIONS[name.lower()] = function


def unregister(name: str) -> None:
    USER_FUNCTIONS.pop(name.lower(), None)
