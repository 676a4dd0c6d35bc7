"""Scan limits: in-band return limits, and out-of-band limits of key-values, bytes and time that scans can share."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")


class StopReason(Enum):
    """Why a scan returns no next item."""

    SOURCE_EXHAUSTED = "source exhausted"
    RETURN_LIMIT_REACHED = "return limit reached"
    TIME_LIMIT_REACHED = "time limit reached"
    BYTE_LIMIT_REACHED = "byte limit reached"
    KEY_VALUE_LIMIT_REACHED = "key value limit reached"

    @property
    def out_of_band(self) -> bool:
        return self in (StopReason.TIME_LIMIT_REACHED, StopReason.BYTE_LIMIT_REACHED, StopReason.KEY_VALUE_LIMIT_REACHED)


@dataclass
class ScanLimiter:
    """A budget that several scans may draw on.  None: not limited (usage is still tracked).

    A key-value is counted when it is tried, so that limit is exact; its bytes are counted after it was read, so the last
    one may go beyond the byte limit.  When several limits are reached, key-values come before bytes and bytes before time."""

    key_values: int | None = None
    bytes: int | None = None
    milliseconds: float | None = None
    used_key_values: int = 0
    used_bytes: int = 0
    began: float = field(default_factory=time.monotonic)

    def left_key_values(self) -> int | None:
        return None if self.key_values is None else max(0, self.key_values - self.used_key_values)

    def left_bytes(self) -> int | None:
        return None if self.bytes is None else max(0, self.bytes - self.used_bytes)

    def time_is_up(self) -> bool:
        return self.milliseconds is not None and (time.monotonic() - self.began) * 1000 >= self.milliseconds

    def left_milliseconds(self) -> float | None:
        return None if self.milliseconds is None else max(0.0, self.milliseconds - (time.monotonic() - self.began) * 1000)

    def reached(self) -> StopReason | None:
        if self.left_key_values() == 0:
            return StopReason.KEY_VALUE_LIMIT_REACHED
        if self.left_bytes() == 0:
            return StopReason.BYTE_LIMIT_REACHED
        return StopReason.TIME_LIMIT_REACHED if self.time_is_up() else None

    def charge(self, key_values: int, n_bytes: int) -> None:
        self.used_key_values += key_values
        self.used_bytes += n_bytes


def in_time(spark: SparkSession, limiter: ScanLimiter, run: Callable[[], Result]) -> Result | None:
    """What run() gives; None if the limiter's time is up before, which also cancels the jobs that run() has started."""
    left = limiter.left_milliseconds()
    if left is None:
        return run()
    context, group, names = spark.sparkContext, f"scan-{uuid.uuid4().hex}", ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [(k, context.getLocalProperty(k)) for k in names]
    timer = threading.Timer(left / 1000, lambda: context._jsc.sc().cancelJobGroupAndFutureJobs(group))
    context.setJobGroup(group, "scan with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return run()
    except Exception:
        if limiter.time_is_up():
            return None
        raise
    finally:
        timer.cancel()
        for k, v in before:
            context.setLocalProperty(k, v)
