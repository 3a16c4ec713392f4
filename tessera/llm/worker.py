"""One operator's memo at a time in a Python worker.

Spark reuses Python workers across stages.  Memos of looked-up values (words,
pieces, tokenizers) live as long as the worker, so the operator that starts to
work drops what another has left.
"""

from __future__ import annotations

from collections.abc import Callable

_owner: list = ["", None]


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say that ``name`` works in this process now; ``clear`` drops its memo later."""
    if _owner[0] != name:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = [name, clear]
