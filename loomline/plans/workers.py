"""Worker plans: a registry of DataFrame functions, configuration merging, closure of references, execution."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_kinds: dict[str, Callable[..., DataFrame]] = {}


def worker(kind: str):
    """Register a function `(inputs: dict, **settings) -> DataFrame` under a kind."""

    def register(f):
        _kinds[kind] = f
        return f

    return register


@dataclass
class Step:
    """One worker of a plan: its kind, what it needs, its settings."""

    id: str
    kind: str
    needs: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    enabled: bool = True


def run(steps: list[Step], inputs: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run enabled steps whose needs are met, in passes, until nothing more can run.

    Returns the outputs by id, and for every step `done`, `present` (given in `inputs`),
    `disabled` or `waiting`. A step is a lazy plan: nothing is computed here."""
    out, state = dict(inputs), {s.id: "waiting" for s in steps}
    go = True
    while go:
        go = False
        for s in steps:
            if state[s.id] != "waiting":
                continue
            if not s.enabled:
                state[s.id] = "disabled"
            elif s.id in inputs:
                state[s.id] = "present"
            elif all(n in out for n in s.needs):
                out[s.id] = _kinds[s.kind]({n: out[n] for n in s.needs}, **s.settings)
                state[s.id], go = "done", True
    return out, state


def references(config) -> set[str]:
    """Every `$ref` in a configuration."""
    if isinstance(config, dict):
        own = {config["$ref"]} if isinstance(config.get("$ref"), str) else set()
        return own.union(*(references(v) for v in config.values()))
    return set().union(*(references(v) for v in config)) if isinstance(config, list) else set()


def closure(shared: dict[str, object], roots: list[object]) -> list[str]:
    """Names of shared objects that the roots reach by references, directly or not."""
    seen: list[str] = []
    todo = sorted(set().union(*(references(r) for r in roots)) if roots else set())
    while todo:
        name = todo.pop(0)
        if name in shared and name not in seen:
            seen.append(name)
            todo += sorted(references(shared[name]) - set(seen))
    return sorted(seen)


def merge_config(base, change, key: str = "Id"):
    """Merge a change into a configuration: objects by name, arrays of objects by their key, with
    `$before` or `$after` to place a new one, anything else replaced."""
    if isinstance(base, dict) and isinstance(change, dict):
        out = copy.deepcopy(base)
        for k, v in change.items():
            out[k] = merge_config(out[k], v, key) if k in out else copy.deepcopy(v)
        return out
    if isinstance(base, list) and isinstance(change, list) and all(isinstance(x, dict) and key in x for x in change):
        out = copy.deepcopy(base)
        for item in change:
            at = next((i for i, x in enumerate(out) if isinstance(x, dict) and x.get(key) == item[key]), None)
            plain = {k: v for k, v in item.items() if k not in ("$before", "$after")}
            if at is not None:
                out[at] = merge_config(out[at], plain, key)
                continue
            place = next((i + ("$after" in item) for i, x in enumerate(out) if isinstance(x, dict) and x.get(key) == item.get("$before", item.get("$after"))), len(out))
            out.insert(place, copy.deepcopy(plain))
        return out
    return copy.deepcopy(change)
