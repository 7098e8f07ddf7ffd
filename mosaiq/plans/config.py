"""Nested settings on the driver: dotted keys, overrides that keep types, study plans."""

from __future__ import annotations

import copy
import itertools
from typing import Any


def get_key(tree: dict, key: str) -> Any:
    for part in key.split("."):
        if not isinstance(tree, dict) or part not in tree:
            raise KeyError(key)
        tree = tree[part]
    return tree


def compatible(old: Any, new: Any) -> bool:
    """Truth values replace truth values, numbers numbers; anything else needs its own type; None takes all."""
    if old is None or new is None:
        return True
    if isinstance(old, bool) or isinstance(new, bool):
        return isinstance(old, bool) and isinstance(new, bool)
    if isinstance(old, (int, float)) and isinstance(new, (int, float)):
        return True
    return type(old) is type(new)


def with_overrides(tree: dict, overrides: dict[str, Any]) -> dict:
    """A copy with dotted keys replaced; keys must exist and types must agree."""
    out = copy.deepcopy(tree)
    for key, value in overrides.items():
        if not compatible(get_key(out, key), value):
            raise TypeError(f"{key}: {type(value).__name__} can't replace {type(get_key(out, key)).__name__}")
        *path, last = key.split(".")
        node = out
        for part in path:
            node = node[part]
        node[last] = value
    return out


def deep_merge(base: dict, more: dict) -> dict:
    out = dict(base)
    for k, v in more.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flatten(tree: dict, prefix: str = "") -> dict[str, Any]:
    """Scalars under their dotted keys."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def reject_unknown(tree: dict, known: set[str], where: str) -> None:
    odd = sorted(set(tree) - known)
    if odd:
        raise ValueError(f"unknown keys in {where}: {', '.join(odd)}")


def parse_thresholds(text: str | None) -> list[float]:
    """Numbers of a comma list; none for an empty text or the word none."""
    if text is None or text.strip().lower() in ("", "none"):
        return []
    return [float(x) for x in text.split(",")]


def domain_failures(tree: dict, rules: dict[str, Any]) -> list[str]:
    """Dotted keys whose rule (a function of the value) doesn't hold, or that are missing, in the rules' order."""
    out = []
    for key, rule in rules.items():
        try:
            good = bool(rule(get_key(tree, key)))
        except (KeyError, TypeError, ValueError):
            good = False
        if not good:
            out.append(key)
    return out


#: Factor designs by name, and templates of settings that a preset fills in; more may be registered.
PRESETS: dict[str, dict[str, list]] = {"alignment": {"accuracy": ["high", "medium"], "tie_points": [4000, 10000]}, "blending": {"blend": ["average", "mosaic"], "mesh": [1, 2]}}
TEMPLATES: dict[str, dict] = {}


def register_preset(name: str, factors: dict[str, list], template: dict | None = None) -> None:
    """A named design; a name that is taken or a factor without levels is an error."""
    if name in PRESETS:
        raise ValueError(f"the preset {name} is there already")
    if not factors or not all(factors.values()):
        raise ValueError("a preset needs factors with levels")
    PRESETS[name] = factors
    if template is not None:
        TEMPLATES[name] = template


def preset_variants(name: str) -> list[dict[str, Any]]:
    """All variants of a preset, with their template if it has one."""
    factors = PRESETS[name]
    rows = [dict(zip(factors, levels, strict=True)) for levels in itertools.product(*factors.values())]
    return [with_overrides(TEMPLATES[name], r) for r in rows] if name in TEMPLATES else rows


def study_plan(factors: dict[str, list], replicates: int) -> list[dict[str, Any]]:
    """All variants of the factors with their replicates."""
    names = list(factors)
    return [dict(zip(names, levels, strict=True)) | {"replicate": r} for levels in itertools.product(*factors.values()) for r in range(1, replicates + 1)]
