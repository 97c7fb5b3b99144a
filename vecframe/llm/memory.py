"""A bounded memory of computed values."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter
from typing import Any


_RELEASES: dict[str, Callable[[], None]] = {}
_USER: list[str] = [""]


def keeps(user: str, release: Callable[[], None]) -> None:
    """An operator says how to let go of what it keeps in a worker from task to task."""
    _RELEASES[user] = release


def using(user: str) -> None:
    """A task of an operator begins: what others kept in this worker goes, so that operators don't add up."""
    if _USER[0] != user:
        _USER[0] = user
        for name, release in _RELEASES.items():
            if name != user:
                release()
        gc.collect()
        _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that: workers live on from stage to stage."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Memory(dict):
    """Values by key, made on first use.  Holds two generations of so many keys each: what the younger one needs again survives."""

    def __init__(self, make: Callable[[str], Any], generation: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.generation, self.longest = make, generation, longest
        self.older: dict[str, Any] = {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key: str, value: Any) -> None:
        if len(self) >= self.generation:
            self._age()
        self[key] = value

    def _age(self) -> None:
        self.older = dict(self)
        self.clear()

    def found(self, keys: list[str]) -> dict[str, Any]:
        """What is known of the keys."""
        out = {k: v for k, v in zip(keys, map(self.get, keys)) if v is not None}
        if self.older and len(out) < len(keys):
            back = [k for k in keys if k not in out]
            again = {k: v for k, v in zip(back, map(self.older.get, back)) if v is not None}
            self.learn(again)
            out |= again
        return out

    def learn(self, values: dict[str, Any]) -> None:
        if len(self) + len(values) > self.generation:
            self._age()
        self.update(values)

    def all(self, keys: list[str]) -> tuple:
        """The values of several keys."""
        return taken(self, keys)


def taken(values: dict[str, Any], keys: list[str]) -> tuple:
    """The values of several keys, fast."""
    if len(keys) < 2:
        return tuple([values[k] for k in keys])
    return itemgetter(*keys)(values)


@contextmanager
def still() -> Iterator[None]:
    """No garbage collection of cycles meanwhile: it would look through the whole memory again and again, and finds nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
