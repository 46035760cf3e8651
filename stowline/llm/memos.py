"""What Python workers remember between batches. Spark keeps workers for the tasks of other operators."""

from __future__ import annotations

_held: list = []


def hold(memo=None) -> None:
    """Called when a task begins: `memo` stays in this worker, what another operator left here is cleared."""
    for other in _held:
        if other is not memo:
            other.clear()
    _held[:] = [] if memo is None else [memo]
