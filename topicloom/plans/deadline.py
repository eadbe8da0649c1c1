"""Work on the driver whose Spark jobs are cancelled when it runs past its time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

# Seconds between two looks for jobs that overdue work has started in the meantime.
LOOK = 0.2

Result = TypeVar("Result")


def within(spark: SparkSession, seconds: float | None, work: Callable[[], Result]) -> Result:
    """The result of ``work``, or ``TimeoutError`` where it takes more than ``seconds`` (None: no limit).

    All jobs of this thread, and of threads that inherit its local properties, carry a tag of their own. Once time is
    over they are cancelled, and so are those that the work still starts, until it gives up; jobs of other
    threads go on. Work that ends after its time has overrun, whatever it returns.
    """
    if seconds is None:
        return work()
    context = spark.sparkContext
    tag = f"deadline-{uuid.uuid4().hex}"
    ended, overdue = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(max(seconds, 0.0)):
            return
        overdue.set()
        while True:
            context.cancelJobsWithTag(tag)
            if ended.wait(LOOK):
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    failure: Exception | None = None
    try:
        result = work()
    except Exception as raised:
        failure = raised
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    if overdue.is_set():
        raise TimeoutError(f"cancelled after {seconds:g} seconds") from failure
    if failure is not None:
        raise failure
    return result
