"""Explicitly registered readers, connectors and renderers."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from lodestone.sources import files, formats


@dataclass(frozen=True)
class ReaderSpec:
    """A reader of further kinds: (bytes) -> units. ``signatures`` are (offset, bytes), negative offsets from the end."""

    name: str
    kind: str
    read: Callable[[bytes], Iterator[formats.Unit]]
    suffixes: tuple[str, ...] = ()
    signatures: tuple[tuple[int, bytes], ...] = ()

    def matches(self, data: bytes) -> bool:
        return any(data[at : at + len(s) or None] == s if at >= 0 else data[len(data) + at : len(data) + at + len(s)] == s for at, s in self.signatures)


@dataclass(frozen=True)
class RendererSpec:
    name: str
    render: Callable[[list[dict]], str]


@dataclass
class Registry:
    """Names, kinds and suffixes belong to one extension each; a set is registered whole or not at all."""

    readers: dict[str, ReaderSpec] = field(default_factory=dict)
    renderers: dict[str, RendererSpec] = field(default_factory=dict)

    def register(self, *specs: ReaderSpec | RendererSpec) -> None:
        readers, renderers = dict(self.readers), dict(self.renderers)
        taken = {s for k in files.SUFFIXES.values() for s in k.split()} | {s for r in readers.values() for s in r.suffixes}
        for spec in specs:
            if isinstance(spec, RendererSpec):
                if spec.name in renderers:
                    raise ValueError(f"renderer {spec.name} is taken")
                renderers[spec.name] = spec
                continue
            clash = taken & set(spec.suffixes)
            if spec.kind in formats.READERS or spec.kind in {r.kind for r in readers.values()} or spec.name in readers or clash:
                raise ValueError(f"reader {spec.name}: its name, kind or suffixes {sorted(clash)} are taken")
            readers[spec.name] = spec
            taken |= set(spec.suffixes)
        self.readers, self.renderers = readers, renderers

    def kind_readers(self) -> dict[str, Callable]:
        """For ``engine.acquire(extra=...)``: readers whose output is checked."""
        return {r.kind: checked(r) for r in self.readers.values()}


def checked(spec: ReaderSpec) -> Callable[[bytes], Iterator[formats.Unit]]:
    """A reader that refuses units of a wrong shape (E5)."""

    def read(data: bytes) -> Iterator[formats.Unit]:
        seen: set[str] = set()
        for unit in spec.read(data):
            modality, content, ref, weight, parent, meta = unit
            if not (isinstance(content, str) and content.strip() and isinstance(ref, str) and ref.strip()):
                raise ValueError(f"{spec.name}: a unit without content or place")
            if not (math.isfinite(weight) and 0 <= weight <= 1) or not isinstance(meta, dict):
                raise ValueError(f"{spec.name}: a unit with a wrong weight or meta")
            if parent is not None and parent not in seen:
                raise ValueError(f"{spec.name}: parent {parent} does not come before {ref}")
            seen.add(ref)
            yield unit

    return read


def load(name: str):
    """``module`` or ``module:factory``, named explicitly."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute or "extension")()
