"""Named values of a run: counters and timers, logged in the marked form that ``statistics.log_values`` reads."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("latticework")


class Metrics:
    """Values by name, in the order of their first appearance."""

    def __init__(self) -> None:
        self.values: dict[str, float | int | str] = {}

    def put(self, name: str, value: float | int | str) -> None:
        self.values[name] = value

    def add(self, name: str, n: float = 1) -> None:
        self.values[name] = self.values.get(name, 0) + n

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Adds the seconds that its block takes."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.add(name, time.monotonic() - began)

    def line(self) -> str:
        shown = (f"[{k}={v:.3f}]" if isinstance(v, float) else f"[{k}={v}]" for k, v in self.values.items())
        return " ".join(["[VAL]", *shown])

    def report(self) -> str:
        """The line, which is logged too."""
        log.info(self.line())
        return self.line()

    def levels(self, level: list) -> None:
        """A hook of the miner: patterns and support of each finished level."""
        self.add("levels")
        self.put(f"patterns_{len(level[0][0])}", len(level))
        log.debug("level of %d edges: %d patterns, best support %d", len(level[0][0]), len(level), max(s for _, s in level))
