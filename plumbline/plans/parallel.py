"""Independent Spark jobs submitted side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

# Jobs in flight at a time; Spark shares the executors among them.
JOBS = 8


def side_by_side(tasks: list[Callable[[], Result]], jobs: int = JOBS) -> list[Result]:
    """Results of the tasks in order; the first exception is raised."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(jobs, len(tasks))) as pool:
        started = [pool.submit(inherit(task)) for task in tasks]
        return [future.result() for future in started]
