"""Send row helpers to the executors along with the task."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value, so that executors need not
    have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
