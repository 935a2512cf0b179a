"""Configuration: JSON with comments, typed lookups with defaults, overrides, dumps."""

from __future__ import annotations

import json
import logging
import re
from typing import Any

_log = logging.getLogger(__name__)
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)


class Config:
    def __init__(self, text: str = "{}"):
        self.values: dict = json.loads(_COMMENT.sub(lambda m: m[1] or "", text))

    def get(self, *path: str, default: Any = None) -> Any:
        """The value at a nested path; a missing one gives the default and a warning, a wrong type an error."""
        at: Any = self.values
        for key in path:
            if not isinstance(at, dict) or key not in at:
                _log.warning("%s is not set; using %r", ".".join(path), default)
                return default
            at = at[key]
        if isinstance(default, bool | int | float | str) and not isinstance(at, type(default)):
            if isinstance(default, float) and isinstance(at, int):
                return float(at)
            raise TypeError(f"{'.'.join(path)} is {type(at).__name__}, not {type(default).__name__}")
        return at

    def pose(self, *path: str, default=(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)) -> tuple[float, ...]:
        """tx ty tz qx qy qz qw, the quaternion normalised."""
        v = [float(x) for x in self.get(*path, default=list(default))]
        if len(v) != 7:
            raise ValueError(f"{'.'.join(path)} has {len(v)} numbers, not 7")
        n = sum(x * x for x in v[3:]) ** 0.5
        return (*v[:3], *(x / n for x in v[3:]))

    def override(self, value: Any, *path: str) -> None:
        at = self.values
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = value

    def dump(self) -> str:
        return json.dumps(self.values, indent=2, sort_keys=True)
