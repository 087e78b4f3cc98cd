"""Listeners of an engine's events; one that fails doesn't keep the others from hearing."""

from collections.abc import Callable
from typing import Any

#: What is told to those who listen to any event: (event, data).
AnyListener = Callable[[str, dict], Any]


class Events:
    def __init__(self, failed: Callable[[Exception], Any] = lambda e: None):
        self._of: dict[str, list[Callable[[dict], Any]]] = {}
        self._all: list[AnyListener] = []
        self._failed = failed

    def on(self, event: str, listener: Callable[[dict], Any]) -> Callable[[], None]:
        """Adds a listener (once, however often it is added) and gives what removes it."""
        own = self._of.setdefault(event, [])
        if listener not in own:
            own.append(listener)
        return lambda: self.off(event, listener)

    def once(self, event: str, listener: Callable[[dict], Any]) -> Callable[[], None]:
        def first(data: dict) -> None:
            self.off(event, first)
            listener(data)

        return self.on(event, first)

    def off(self, event: str, listener: Callable[[dict], Any]) -> None:
        if listener in self._of.get(event, []):
            self._of[event].remove(listener)

    def on_any(self, listener: AnyListener) -> Callable[[], None]:
        self._all.append(listener)
        return lambda: self._all.remove(listener) if listener in self._all else None

    def clear(self) -> None:
        self._of.clear()
        self._all.clear()

    def emit(self, event: str, data: dict) -> None:
        """Tells those who listen now; they may remove themselves meanwhile."""
        for call in [*(lambda f=f: f(data) for f in list(self._of.get(event, []))), *(lambda f=f: f(event, data) for f in list(self._all))]:
            try:
                call()
            except Exception as e:  # noqa: BLE001
                self._failed(e)
