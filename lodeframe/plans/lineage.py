"""Staleness of derived results: which recipes and sources a result was made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


def fingerprint(*parts: Any) -> str:
    return hashlib.sha256("\x1f".join(map(repr, parts)).encode()).hexdigest()


@dataclass
class Derivation:
    """One derived result: the names it is made from, how, and the fingerprint of what it was last made from."""

    sources: tuple[str, ...]
    derive: Callable[[], Any]
    made_from: str | None = None
    output: Any = None


@dataclass
class Registry:
    """Named sources with a version each, and derivations over them and over each other.

    Spark's own lineage recomputes lazily; this only tells when a result that was written down no longer fits.
    """

    versions: dict[str, str] = field(default_factory=dict)
    nodes: dict[str, Derivation] = field(default_factory=dict)

    def source(self, name: str, version: Any) -> None:
        self.versions[name] = fingerprint(version)

    def add(self, name: str, sources: tuple[str, ...], derive: Callable[[], Any]) -> None:
        self.nodes[name] = Derivation(sources, derive)

    def state(self, name: str, path: tuple[str, ...] = ()) -> str:
        """Fingerprint of everything that a name depends on."""
        if name in path:
            raise ValueError(f"cycle: {' -> '.join((*path, name))}")
        if name not in self.nodes:
            return self.versions.get(name, fingerprint(None))
        return fingerprint(name, *(self.state(s, (*path, name)) for s in self.nodes[name].sources))

    def stale(self) -> list[str]:
        """Derived results that were never made or whose sources have changed since."""
        return [n for n, d in self.nodes.items() if d.made_from != self.state(n)]

    def refresh(self, name: str) -> Any:
        """The result, made anew with all it depends on only where stale."""
        node = self.nodes[name]
        for s in node.sources:
            if s in self.nodes:
                self.refresh(s)
        if node.made_from != (now := self.state(name)):
            node.output, node.made_from = node.derive(), now
        return node.output
