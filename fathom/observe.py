"""Traces and logs: functions that say in Spark's job list and in the log what runs, for how long, and with what."""

from __future__ import annotations

import functools
import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


def enabled() -> bool:
    return os.environ.get("FATHOM_TRACE", "").lower() in ("1", "true", "yes")


def logger(name: str = "fathom") -> logging.Logger:
    return logging.getLogger(name)


def configure(level: str = "INFO") -> None:
    logging.basicConfig(level=level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")


def note(**facts: object) -> None:
    """Facts added to the log and to the description of the jobs that follow."""
    text = " ".join(f"{k}={v}" for k, v in sorted(facts.items()))
    logger().info(text)
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.sparkContext.setJobDescription(text)


def traced(name: str) -> Callable:
    """A function whose jobs carry its name and whose time is logged; as it is where traces are off."""

    def around(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **more):
            if not enabled():
                return f(*args, **more)
            start = time.perf_counter()
            note(trace=name)
            try:
                return f(*args, **more)
            finally:
                logger().info("%s took %.3f s", name, time.perf_counter() - start)

        return run

    return around
