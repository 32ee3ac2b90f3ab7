"""Truth, closures, macros, environments."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from sigspark.lang.reader import Symbol


class LangError(Exception):
    pass


def truth(v: Any) -> bool:
    """False for nil, #f, 0, 0.0, empty text and empty lists."""
    if v is None or v is False:
        return False
    if isinstance(v, (int, float, list)) or isinstance(v, str) and not isinstance(v, Symbol):
        return bool(v)
    return True


class Env:
    """A frame of bindings; inner frames see and change outer ones."""

    __slots__ = ("names", "outer")

    def __init__(self, outer: Env | None = None, names: dict[str, Any] | None = None):
        self.names, self.outer = names if names is not None else {}, outer

    def frame(self, name: str) -> Env | None:
        e: Env | None = self
        while e is not None and name not in e.names:
            e = e.outer
        return e

    def get(self, name: str) -> Any:
        if (e := self.frame(name)) is None:
            raise KeyError(name)
        return e.names[name]

    def set(self, name: str, value: Any) -> None:
        if (e := self.frame(name)) is None:
            raise LangError(f"set!: {name} is not defined")
        e.names[name] = value


@dataclass
class Closure:
    env: Env
    params: list[str]
    body: list
    name: str = "<anonymous>"
    rest: str | None = None

    def __str__(self) -> str:
        return f"<closure {self.name}>"

    def bind(self, args: list) -> Env:
        if self.rest is None and len(args) != len(self.params) or len(args) < len(self.params):
            raise LangError(f"{self.name}: {len(self.params)} arguments expected, {len(args)} given")
        names = dict(zip(self.params, args, strict=False))
        if self.rest is not None:
            names[self.rest] = args[len(self.params) :]
        return Env(self.env, names)


@dataclass
class Macro(Closure):
    def __str__(self) -> str:
        return f"<macro {self.name}>"


@dataclass
class Builtin:
    name: str
    call: Any
    least: int = 0
    most: int | None = None

    def __str__(self) -> str:
        return self.name


@dataclass
class Virtual:
    """A named derived signal: its form, compiled or evaluated where it is read."""

    form: Any
    env: Env
    uses: set[str] = field(default_factory=set)
