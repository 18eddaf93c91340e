"""Threads of numpy's products."""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np


def one_blas_thread() -> None:
    """Let numpy's products run in the task's own thread.

    Tasks are what a cluster runs in parallel; a second thread of the small
    products here only spins on another task's core.
    """
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
