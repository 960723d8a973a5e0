"""Memory of Python workers between tasks, and shuffle files of finished steps."""

from __future__ import annotations

import ctypes
import gc
import time


def give_back(cycles: bool = True) -> None:
    """Return freed memory to the system.

    Spark keeps Python workers for later tasks, and freed blocks stay with the
    allocators: an idle worker would hold its largest batch for as long as the
    application runs.  Without ``cycles`` no objects that hold each other are
    looked for, which takes long beside a small group.
    """
    import pyarrow

    if cycles:
        gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def release_shuffles(spark, rounds: int = 4, pause: float = 0.2) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, checkpointed steps now, not at the driver's next full collection.

    The references lie behind one another (Python's, the plan's, the shuffle's),
    and each collection finds one layer more, so there are a few of them.
    """
    jvm = getattr(spark, "_jvm", None)
    for _ in range(rounds if jvm is not None else 0):
        gc.collect()
        jvm.System.gc()
        time.sleep(pause)
