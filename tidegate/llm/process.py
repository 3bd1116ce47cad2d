"""Values that a Python worker keeps between tasks."""

import sys
import types
from collections.abc import Callable, Hashable


def kept(key: Hashable, make: Callable):
    """The value of ``key``, made once per process.

    Functions may travel to the workers by value, with globals of their own in every task, so the
    values are held by a module that only exists in the process. Keep small, bounded values.
    """
    name = "tidegate_process_values"
    values = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in values:
        values[key] = make()
    return values[key]
