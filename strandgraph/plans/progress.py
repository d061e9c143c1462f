"""Progress reports of iterative operators: callables of (done, total)."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field


def no_progress(done: int, total: int) -> None:
    """Say nothing."""


@dataclass
class ConsoleProgress:
    name: str = "progress"
    out: object = field(default=sys.stderr)

    def __call__(self, done: int, total: int) -> None:
        print(f"{self.name}: {done} of {total}", file=self.out)


@dataclass
class Throttled:
    """Passes a report on at most every ``seconds``, and always the last one."""

    report: object
    seconds: float = 0.5
    last: float = 0.0

    def __call__(self, done: int, total: int) -> None:
        now = time.monotonic()
        if done >= total or now - self.last >= self.seconds:
            self.last = now
            self.report(done, total)
