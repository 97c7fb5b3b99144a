"""Own lowerings: functions over vectors under a name, with a fixed number of arguments."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .vec import Vec, lift

_FUNCTIONS: dict[str, tuple[Callable[..., Vec], int]] = {}


def register(name: str, function: Callable[..., Vec], arity: int) -> None:
    """Adds or replaces a lowering.  It gets vectors and returns one, so that it fuses with what is around it."""
    _FUNCTIONS[name] = function, arity


def call(name: str, *arguments: Any) -> Vec:
    if name not in _FUNCTIONS:
        raise NameError(name)
    function, arity = _FUNCTIONS[name]
    if len(arguments) != arity:
        raise TypeError(f"{name} takes {arity} arguments, not {len(arguments)}")
    return function(*map(lift, arguments))


def registered() -> list[str]:
    return sorted(_FUNCTIONS)
