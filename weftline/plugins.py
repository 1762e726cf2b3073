"""What plugins add: parsers, audit rules, search hooks, tools; and events."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from .sources import parsers

log = logging.getLogger(__name__)


# The names of the events that a graph with a registry emits.
EVENTS = ("search:executed", "read:result:after", "orient:contribute", "node:add", "file:change", "node:remove")


class Events:
    """Handlers by event name, called one after another, those for all events first; their errors are logged."""

    def __init__(self):
        self._handlers: dict[str, list[Callable]] = {}

    def on(self, event: str, handler: Callable) -> Callable[[], None]:
        self._handlers.setdefault(event, []).append(handler)
        return lambda: self.off(event, handler)

    def off(self, event: str, handler: Callable) -> None:
        if handler in self._handlers.get(event, []):
            self._handlers[event].remove(handler)

    def once(self, event: str, handler: Callable) -> None:
        def first(payload):
            self.off(event, first)
            handler(payload)

        self.on(event, first)

    def emit(self, event: str, payload=None) -> None:
        for handler in [*self._handlers.get("*", []), *self._handlers.get(event, [])]:
            try:
                handler(payload)
            except Exception:
                log.exception("handler of %s", event)

    async def emit_async(self, event: str, payload=None) -> None:
        """``emit`` for handlers that may be coroutines, each awaited before the next begins."""
        for handler in [*self._handlers.get("*", []), *self._handlers.get(event, [])]:
            try:
                found = handler(payload)
                if inspect.isawaitable(found):
                    await found
            except Exception:
                log.exception("handler of %s", event)


@dataclass
class Registry:
    plugins: dict[str, object] = field(default_factory=dict)
    rules: list = field(default_factory=list)
    hooks: list[Callable] = field(default_factory=list)
    tools: dict[str, Callable] = field(default_factory=dict)
    events: Events = field(default_factory=Events)
    parsers: dict[str, Callable] = field(default_factory=lambda: dict(parsers.PARSERS))
    contributions: list[tuple[int, str]] = field(default_factory=list)
    _before: dict[str, dict] = field(default_factory=dict)
    _added: dict[str, dict] = field(default_factory=dict)

    def add(self, plugin) -> None:
        """``plugin`` has a unique name and a method register(registry)."""
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name} is there already")
        self.plugins[plugin.name] = plugin
        self._before[plugin.name] = self._state()
        plugin.register(self)
        self._added[plugin.name] = {k: [x for x in now if x not in was] for (k, now), was in zip(self._state().items(), self._before[plugin.name].values(), strict=True)}

    def _state(self) -> dict[str, list]:
        return {"rules": list(self.rules), "hooks": list(self.hooks), "tools": list(self.tools.items()), "parsers": list(self.parsers.items()), "contributions": list(self.contributions)}

    def remove(self, name: str) -> None:
        """Takes a plugin out with the rules, hooks, tools, parsers and lines that it added; parsers that it replaced are back."""
        self.plugins.pop(name)
        added, before = self._added.pop(name), self._before.pop(name)
        for own in ("rules", "hooks", "contributions"):
            kept = getattr(self, own)
            kept[:] = [x for x in kept if x not in added[own]]
        for own in ("tools", "parsers"):
            kept, was = getattr(self, own), dict(before[own])
            for key, value in added[own]:
                if kept.get(key) is value:
                    del kept[key]
                    if key in was:
                        kept[key] = was[key]

    def add_parser(self, extension: str, parse: Callable[[str], list[tuple]]) -> None:
        """``parse``: a text to rows (name, kind, start line and column, end line and column, exported, owner).

        ``symbols`` of this registry routes files of the extension to it, and so does a graph that has ``parsers`` as its ``known``.
        """
        self.parsers[extension] = parse

    def symbols(self, files):
        return parsers.symbols(files, self.parsers)

    def contribute(self, text: str, priority: int = 0) -> None:
        """A line for the report to start work with."""
        self.contributions.append((priority, text))

    def orientation(self) -> list[str]:
        """The contributed lines, the highest priority first."""
        return [text for _, text in sorted(self.contributions, key=lambda c: -c[0])]

    def add_tool(self, name: str, f: Callable) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name} is there already")
        self.tools[name] = f
