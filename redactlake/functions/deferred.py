"""Column expressions written before a session exists.

Queries are declared at import, when there may be no JVM to make columns in. A
deferred module makes columns at once if a session is active, and otherwise an
expression that is carried out when the query is built.
"""

from __future__ import annotations

import operator
from types import ModuleType
from typing import Any

from pyspark import SparkContext
from pyspark.sql.classic.column import Column


class Deferred:
    """Passes for a column where a data frame asks for one: by then there is a session to make it in."""

    def __init__(self, make):
        self.__dict__["_make"] = make

    @property
    def __class__(self):
        return Column

    @property
    def _jc(self):
        return resolved(self)._jc

    def __getattr__(self, name: str) -> Deferred:
        if name.startswith("__"):
            raise AttributeError(name)
        return Deferred(lambda: getattr(resolved(self), name))

    def __call__(self, *args: Any, **kwargs: Any) -> Deferred:
        return Deferred(lambda: resolved(self)(*resolved(args), **resolved(kwargs)))

    def __getitem__(self, key: Any) -> Deferred:
        return Deferred(lambda: resolved(self)[resolved(key)])

    def __invert__(self) -> Deferred:
        return Deferred(lambda: ~resolved(self))

    def __neg__(self) -> Deferred:
        return Deferred(lambda: -resolved(self))

    __hash__ = object.__hash__


def _binary(name: str):
    op = getattr(operator, f"__{name}__")
    return (lambda self, other: Deferred(lambda: op(resolved(self), resolved(other)))), (lambda self, other: Deferred(lambda: op(resolved(other), resolved(self))))


for _name in ("add", "sub", "mul", "truediv", "mod", "and", "or", "eq", "ne", "lt", "le", "gt", "ge"):
    _plain, _swapped = _binary(_name)
    setattr(Deferred, f"__{_name}__", _plain)
    if _name not in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(Deferred, f"__r{_name}__", _swapped)


def resolved(x: Any) -> Any:
    """x with every deferred expression in it carried out."""
    if type(x) is Deferred:
        return resolved(x._make())
    if isinstance(x, tuple):
        return type(x)(*map(resolved, x)) if hasattr(x, "_fields") else tuple(map(resolved, x))
    if isinstance(x, list):
        return [resolved(y) for y in x]
    if isinstance(x, dict):
        return {k: resolved(v) for k, v in x.items()}
    return x


class DeferredModule:
    """A module whose functions wait for a session."""

    def __init__(self, module: ModuleType):
        self._module = module

    def __getattr__(self, name: str) -> Any:
        real = getattr(self._module, name)
        if not callable(real) or isinstance(real, type):
            return real

        def call(*args: Any, **kwargs: Any) -> Any:
            if SparkContext._active_spark_context is not None:
                return real(*resolved(args), **resolved(kwargs))
            return Deferred(lambda: real(*resolved(args), **resolved(kwargs)))

        return call
