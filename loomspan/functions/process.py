"""Values kept once per Python process.

Functions reach the workers by value, so a module's own variables are made anew for every task; what
is costly to build is kept in the interpreter's module table instead, which tasks of a worker share.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def once(key: str, make: Callable, family: str = ""):
    """make() for the first caller of this process, the same value for all others.  Of the keys that start
    with `family` only the one asked for last is kept."""
    kept = sys.modules.setdefault("_loomspan_process", types.ModuleType("_loomspan_process")).__dict__
    if key not in kept:
        for other in [k for k in kept if family and k.startswith(family)]:
            del kept[other]
        kept[key] = make()
    return kept[key]
