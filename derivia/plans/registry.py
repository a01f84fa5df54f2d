"""Stages by kind and name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

KINDS = ("generator", "synthesizer", "noiser", "linker", "structure")
_stages: dict[str, dict[str, Any]] = {k: {} for k in KINDS}


def _of(kind: str) -> dict[str, Any]:
    if kind not in _stages:
        raise KeyError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    return _stages[kind]


def register(kind: str, name: str, *, overwrite: bool = False) -> Callable[[Any], Any]:
    """Decorator that names a class, or anything, as a stage of a kind."""

    def put(stage: Any) -> Any:
        known = _of(kind)
        if name in known and not overwrite:
            raise ValueError(f"{kind} {name!r} is registered already; say overwrite=True to replace it")
        known[name] = stage
        return stage

    return put


def unregister(kind: str, name: str) -> None:
    if name not in _of(kind):
        raise KeyError(f"no {kind} {name!r}; registered: {available(kind)}")
    del _of(kind)[name]


def resolve(kind: str, stage: Any) -> Any:
    """A stage as given, or made from the class registered under a name."""
    if not isinstance(stage, str):
        return stage
    if stage not in _of(kind):
        raise KeyError(f"no {kind} {stage!r}; registered: {available(kind)}")
    found = _of(kind)[stage]
    return found() if isinstance(found, type) else found


def available(kind: str) -> list[str]:
    return sorted(_of(kind))
