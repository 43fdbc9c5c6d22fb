"""Things by name, which a query picks when it is planned: an unknown name raises before a job runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Generic, TypeVar

Held = TypeVar("Held")


class Registry(Generic[Held]):
    """Named things of one kind."""

    def __init__(self, kind: str):
        self.kind = kind
        self._held: dict[str, Held] = {}

    def add(self, name: str, thing: Held) -> Held:
        """Register under a new name."""
        if not name or name in self._held:
            raise ValueError(f"the {self.kind} needs a new name, not {name!r}")
        self._held[name] = thing
        return thing

    def __getitem__(self, name: str) -> Held:
        if name not in self._held:
            raise ValueError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._held))}")
        return self._held[name]

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._held))
