"""What a Python worker remembers between texts: one operator's memory at a time.

Workers are used again by later stages of a job; what an earlier operator remembers would
stay and add up. Whoever starts to remember claims the worker and gives the name of a
function that forgets; the one before is made to forget.
"""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None]) -> None:
    """From now on this worker remembers for ``owner`` only."""
    if owner not in _HELD:
        for other in _HELD.values():
            other()
        _HELD.clear()
        _HELD[owner] = forget
