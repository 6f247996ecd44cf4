"""Settings of an index: what is given first, then the environment, then the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from lectern.sources.scope import home_of

PREFIX = "LECTERN_"
# Spellings of on and off.
ON, OFF = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    root: str = "."
    base: str = "lectern-index"
    model: str = ""
    exclude: tuple[str, ...] = ()
    git: bool = True
    due_after_change: float = 10.0
    due_after_walk: float = 300.0

    @property
    def home(self) -> str:
        """Where the index of this root and model lives."""
        return home_of(self.root, self.base, self.model)


def _read(name: str, text: str, kind: object) -> object:
    """A setting that was given as text. What a launcher should have filled in, and did not, is refused."""
    if "${" in text:
        raise ValueError(f"{name}: {text!r} was never filled in")
    if isinstance(kind, bool):
        low = text.strip().lower()
        if low not in ON + OFF:
            raise ValueError(f"{name}: {text!r} is neither on nor off")
        return low in ON
    if isinstance(kind, tuple):
        return tuple(p for part in text.replace("\n", ",").split(",") if (p := part.strip()))
    return type(kind)(text)


def resolved(given: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of flags that were ``given`` (None counts as not), of variables, and of defaults, in this order."""
    given, environment = given or {}, os.environ if environment is None else environment
    unknown = given.keys() - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    found = {}
    for f in fields(Settings):
        value = given.get(f.name)
        if value is None and (told := environment.get(PREFIX + f.name.upper(), "")).strip():
            value = told
        if value is not None:
            found[f.name] = _read(f.name, value, f.default) if isinstance(value, str) else value
    return Settings(**found)
