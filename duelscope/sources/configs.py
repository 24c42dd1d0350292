"""Policies and parameters from JSON: strict keys, frozen values, and a digest of what was meant."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields
from pathlib import Path
from typing import TypeVar

from ..operators.market import Policy
from ..operators.replay import Variant
from .files import SourceError

Kind = TypeVar("Kind", Variant, Policy)


def digest(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _strict(kind: type[Kind], given: dict) -> Kind:
    known = {f.name for f in fields(kind)}
    if extra := set(given) - known:
        raise SourceError(f"unknown keys: {sorted(extra)}")
    return kind(**given)


def load(kind: type[Kind], path: str, section: str) -> list[Kind]:
    """The entries of a section as variants or policies; names do not repeat."""
    found = [_strict(kind, x) for x in json.loads(Path(path).read_text())[section]]
    names = [next(iter(asdict(x).values())) for x in found]
    if len(set(names)) < len(names):
        raise SourceError("a name is given twice")
    for x in found:
        _check(x)
    return found


def _check(x: Variant | Policy) -> None:
    if isinstance(x, Variant):
        ok = x.k > 0 and 0 <= x.weight <= 1 and 0 <= x.retirement <= 1 and x.duplicates in ("current", "skip_all", "keep_one") and (x.half_life is None or x.half_life > 0)
    else:
        ok = x.method in ("proportional", "additive", "power") and x.aggregation in ("mean", "median") and x.minimum_named >= 1
    if not ok:
        raise SourceError(f"values out of range: {x}")


def frozen(config: dict, expected: dict) -> None:
    """Values that a study fixed beforehand must be what they were."""
    if changed := {k: (config.get(k), v) for k, v in expected.items() if config.get(k) != v}:
        raise SourceError(f"frozen values changed: {changed}")


def digests(entries: list[Variant] | list[Policy]) -> dict[str, str]:
    return {next(iter(asdict(x).values())): digest(asdict(x)) for x in entries}


def file_digests(paths: list[str]) -> dict[str, str]:
    """SHA-256 of files, to tell before and after a run whether any changed."""
    return {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}


def unchanged(before: dict[str, str]) -> None:
    now = file_digests(list(before))
    if changed := [p for p in before if now[p] != before[p]]:
        raise SourceError(f"reviewed files changed: {changed}")
