"""Named groups of callables, and judges by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self._groups: dict[str, dict[str, Callable]] = {}

    def register(self, group: str) -> Callable[[str], Callable]:
        def named(name: str) -> Callable:
            def keep(f: Callable) -> Callable:
                self._groups.setdefault(group, {})[name] = f
                return f

            return keep

        return named

    def __getitem__(self, group: str) -> dict[str, Callable]:
        return self._groups.setdefault(group, {})


registry = Registry()
