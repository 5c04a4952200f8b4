"""Routing plugins: Python callables that see a statement's context and may choose its shards or role."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum

#: Of the context and the hint; a plugin made for another major version is refused.
VERSION = (1, 0)


class Shard(Enum):
    DIRECT = "direct"
    ALL = "all"
    UNKNOWN = "unknown"  # the plugin has no opinion
    BLOCKED = "blocked"


@dataclass(frozen=True)
class PluginContext:
    """What a plugin may know of a statement."""

    tables: tuple[str, ...]
    shards: int
    sharded: bool
    read: bool
    sql: str = ""
    parameters: dict = field(default_factory=dict)
    read_only: bool = False
    has_primary: bool = True
    has_replicas: bool = True
    write_override: bool = False

    def parameter_types(self) -> dict[str, str]:
        return {k: "null" if v is None else type(v).__name__ for k, v in self.parameters.items()}


@dataclass(frozen=True)
class RouteHint:
    """A plugin's answer: shards (numbers where direct) and whether the statement reads (None: no opinion)."""

    shard: Shard = Shard.UNKNOWN
    numbers: Iterable[int] | None = None
    read: bool | None = None


Plugin = Callable[[PluginContext], "RouteHint | tuple | None"]


class Registry:
    """Plugins in the order of their names' registration, with their start and end."""

    def __init__(self) -> None:
        self._plugins: dict[str, tuple[Plugin, Callable[[], None] | None]] = {}

    def register(self, name: str, route: Plugin, version: tuple[int, int] = VERSION, init: Callable[[dict], None] | None = None, fini: Callable[[], None] | None = None, config: dict | None = None) -> None:
        if version[0] != VERSION[0] or version[1] > VERSION[1]:
            raise ValueError(f"plugin {name} is made for version {version}, this is {VERSION}")
        if name in self._plugins:
            raise ValueError(f"two plugins named {name}")
        if init:
            init(config or {})
        self._plugins[name] = (route, fini)

    @property
    def plugins(self) -> tuple[Plugin, ...]:
        return tuple(p for p, _ in self._plugins.values())

    def close(self) -> None:
        for _, fini in self._plugins.values():
            if fini:
                fini()
        self._plugins.clear()


def primary_only(tables: Iterable[str]) -> Plugin:
    """An example: statements over any of the tables go to the primary, wherever else they would go."""
    names = frozenset(tables)
    return lambda c: RouteHint(read=False) if names & set(c.tables) else None
