"""Keeping an index up with its folder while it is used: when a run is due, and one at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from lectern.engine import Engine, Report
from lectern.sources.scope import Busy


@dataclass
class Due:
    """Whether a run is due: after a change was seen, once that is ``change`` seconds old; else once the last walk is
    ``walk`` seconds old; never while another holds the index, which is asked again ``retry`` seconds later."""

    change: float = 10.0
    walk: float = 300.0
    retry: float = 30.0
    clock: Callable[[], float] = time.monotonic
    walked: float | None = None
    changed: float | None = None
    refused: float | None = None

    def saw_change(self) -> None:
        self.changed = self.clock() if self.changed is None else self.changed

    def ran(self) -> None:
        self.walked, self.changed, self.refused = self.clock(), None, None

    def was_refused(self) -> None:
        self.refused = self.clock()

    def now(self) -> bool:
        at = self.clock()
        if self.refused is not None and at - self.refused < self.retry:
            return False
        if self.walked is None:
            return True
        return at - self.walked >= self.walk or self.changed is not None and at - self.changed >= self.change


@dataclass
class CatchUp:
    """Runs of an engine over its folder, set off by use. Only one is under way; it can be asked to stop before it writes."""

    engine: Engine
    directory: str
    due: Due = field(default_factory=Due)
    report: Report | None = None
    error: Exception | None = None
    _thread: threading.Thread | None = None
    _stop: threading.Event = field(default_factory=threading.Event)

    def touch(self) -> bool:
        """To be called with each use: starts a run if one is due and none is under way; whether it did."""
        if self.running or not self.due.now():
            return False
        self._stop.clear()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return True

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def stop(self, wait: float | None = None) -> None:
        """Ask a run to end before it writes, and wait for it."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join(wait)

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)

    def _run(self) -> None:
        try:
            self.report, self.error = self.engine.index_directory(self.directory, stop=self._stop.is_set), None
            self.due.ran()
        except Busy:
            self.due.was_refused()
        except InterruptedError:
            pass
        except Exception as error:  # kept for the caller: a background run must not end the session
            self.error = error
            self.due.was_refused()
