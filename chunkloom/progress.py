"""How far a run has come, told to whoever asks: nothing by default."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol


class Progress(Protocol):
    def start(self, total: int, what: str) -> None: ...

    def advance(self, what: str) -> None: ...

    def finish(self) -> None: ...


class Silent:
    """Tells nobody."""

    def start(self, total: int, what: str) -> None: ...

    def advance(self, what: str) -> None: ...

    def finish(self) -> None: ...


class Told(Silent):
    """Calls ``listener(done, total, what)`` at every step."""

    def __init__(self, listener: Callable[[int, int, str], None]) -> None:
        self.listener, self.done, self.total = listener, 0, 0

    def start(self, total: int, what: str) -> None:
        self.done, self.total = 0, total
        self.listener(0, total, what)

    def advance(self, what: str) -> None:
        self.done += 1
        self.listener(self.done, self.total, what)

    def finish(self) -> None:
        self.listener(self.total, self.total, "done")
