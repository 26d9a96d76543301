"""Policy specs: small driver-side configuration with strict parsing and merge patches."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass, field
from typing import Any

from policylens.schema import MAX_ACTION_ID_CHARS, MAX_ACTIONS, MAX_REWARD_WAIT_SECONDS

# The defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "actions": [],
    "reward": {"range": [0.0, 1.0], "default": None, "waitSeconds": 600},
    "exploration": {
        "kind": "squarecb",
        "gammaScale": 10.0,
        "gammaExponent": 0.5,
        "epsilon": 0.05,
        "floor": 0.05,
    },
    "learner": {
        "bits": 18,
        "learningRate": 0.5,
        "importance": "none",
        "maxImportanceWeight": 100.0,
    },
    "mode": "learner",
    "baselineEpsilon": 0.1,
    "seed": None,
    "snapshotEvery": 1000,
    "rewards": "first",
}

# Fixed values: (setting, lowest, highest, lowest itself allowed).
RANGES = [
    (("exploration", "gammaScale"), 0.0, 1e6, True),
    (("exploration", "gammaExponent"), 0.0, 1.0, True),
    (("exploration", "epsilon"), 0.0, 1.0, True),
    (("exploration", "floor"), 0.0, 1.0, False),
    (("learner", "learningRate"), 0.0, 10.0, False),
    (("learner", "maxImportanceWeight"), 1.0, 1e6, True),
    (("baselineEpsilon",), 0.0, 1.0, False),
]
INTEGERS = [
    (("reward", "waitSeconds"), 1, MAX_REWARD_WAIT_SECONDS),
    (("learner", "bits"), 10, 24),
    (("snapshotEvery",), 1, 1_000_000_000),
]
CHOICES = [
    (("exploration", "kind"), ("squarecb", "epsilonGreedy")),
    (("learner", "importance"), ("none", "mtr")),
    (("mode",), ("learner", "baselineExplore", "frozen")),
    (("rewards",), ("first", "sum")),
]


class SpecError(ValueError):
    """The spec is not usable."""


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7396 merge patch; returns a new document."""
    if not isinstance(patch, dict):
        return copy.deepcopy(patch)
    out = dict(target) if isinstance(target, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merge_patch(out.get(name), value)
    return out


@dataclass(frozen=True)
class PolicySpec:
    """A validated spec; `doc` is the full document with defaults filled in."""

    doc: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    @staticmethod
    def of(doc: dict[str, Any] | None = None) -> "PolicySpec":
        full = copy.deepcopy(DEFAULTS)
        for name, value in (doc or {}).items():
            if name not in full:
                raise SpecError(f"unknown field {name}")
            if isinstance(full[name], dict):
                if not isinstance(value, dict):
                    raise SpecError(f"{name} must be an object")
                unknown = set(value) - set(full[name])
                if unknown:
                    raise SpecError(f"unknown field {name}.{sorted(unknown)[0]}")
                full[name].update(value)
            else:
                full[name] = value
        spec = PolicySpec(full)
        spec.check()
        return spec

    def get(self, *path: str) -> Any:
        node: Any = self.doc
        for part in path:
            node = node[part]
        return node

    def check(self) -> None:
        for path, low, high, closed in RANGES:
            v = self.get(*path)
            if not (_number(v) and (low <= v if closed else low < v) and v <= high):
                raise SpecError(f"{'.'.join(path)} is out of range: {v}")
        for path, low, high in INTEGERS:
            v = self.get(*path)
            if not (isinstance(v, int) and not isinstance(v, bool) and low <= v <= high):
                raise SpecError(f"{'.'.join(path)} must be an integer in [{low}, {high}]: {v}")
        for path, allowed in CHOICES:
            if self.get(*path) not in allowed:
                raise SpecError(f"{'.'.join(path)} must be one of {allowed}")
        bounds = self.get("reward", "range")
        if not (
            isinstance(bounds, list)
            and len(bounds) == 2
            and all(_number(b) for b in bounds)
            and bounds[0] < bounds[1]
            and math.isfinite(bounds[1] - bounds[0])
        ):
            raise SpecError("reward.range must be [lo, hi] with lo < hi")
        default = self.get("reward", "default")
        if default is not None and not _number(default):
            raise SpecError("reward.default must be a finite number")
        seed = self.get("seed")
        if seed is not None and not (isinstance(seed, int) and 0 <= seed < 2**64):
            raise SpecError("seed must be an unsigned 64-bit integer")
        ids = set()
        if not isinstance(self.doc["actions"], list) or len(self.doc["actions"]) > MAX_ACTIONS:
            raise SpecError(f"actions must be a list of at most {MAX_ACTIONS}")
        for action in self.doc["actions"]:
            if not isinstance(action, dict) or set(action) - {"id", "features"}:
                raise SpecError("an action has an id and optional features")
            name = action.get("id")
            if not isinstance(name, str) or not 1 <= len(name) <= MAX_ACTION_ID_CHARS:
                raise SpecError("an action id has 1 to 256 characters")
            if name in ids:
                raise SpecError(f"action {name} is listed twice")
            if not isinstance(action.get("features", {}), dict):
                raise SpecError("action features must be an object")
            ids.add(name)

    def patched(self, patch: dict[str, Any]) -> "PolicySpec":
        """The spec with a merge patch applied; null restores a default."""
        if not isinstance(patch, dict):
            raise SpecError("a spec patch must be an object")
        return PolicySpec.of(merge_patch(self.doc, patch))

    def json(self) -> str:
        """Compact text with sorted keys, so equal specs give equal text."""
        return json.dumps(self.doc, sort_keys=True, separators=(",", ":"))

    def decide_json(self) -> str:
        """The part of the spec that determines decisions, for model tags."""
        doc = {
            "version": 1,
            "actions": [
                {k: v for k, v in a.items() if k != "features" or v} for a in self.doc["actions"]
            ],
            "exploration": self.doc["exploration"],
            "mode": self.doc["mode"],
            "baselineEpsilon": self.doc["baselineEpsilon"],
            "bits": self.get("learner", "bits"),
            "rewards": self.doc["rewards"],
        }
        if self.doc["seed"] is not None:
            doc["seed"] = self.doc["seed"]
        return json.dumps(doc, sort_keys=True, separators=(",", ":"))
