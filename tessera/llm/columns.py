"""Columns that an operator passes on, kept apart from those it works with."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def apart(*outputs: str) -> Callable:
    """For operators ``fn(docs, ...)`` that pass the columns of ``docs`` on.

    Columns that no argument names travel under names of their own and get back theirs, so they
    clash with nothing the operator adds on the way.  ``outputs`` are arguments that name
    added columns; an input column of a name that the result adds is kept as ``src_<name>``."""
    def of(fn):
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            given = inspect.signature(fn).bind(docs, *args, **options)
            given.apply_defaults()
            named = {v for k, v in given.arguments.items() if isinstance(v, str) and k not in outputs}
            own = {c: f"__column{i}__" for i, c in enumerate(docs.columns) if c not in named}
            quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
            out = fn(docs.select(*[quoted(c).alias(own.get(c, c)) for c in docs.columns]), *args, **options)
            back = {v: k for k, v in own.items()}
            added = {c for c in out.columns if c not in back}
            name = lambda c: f"src_{back[c]}" if back.get(c) in added else back.get(c, c)
            return out.select(*[F.col(c).alias(name(c)) for c in out.columns])
        return run
    return of
