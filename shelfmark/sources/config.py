"""Strict JSON configuration with ${NAME} placeholders from the environment."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields

from shelfmark.functions.paths import GROUPINGS
from shelfmark.operators.paging import ADAPTER_PAGE, page_limit

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


@dataclass(frozen=True)
class Config:
    """Defaults: a scan every 30 minutes, a poll every 5 seconds, a lease of 5 minutes renewed every minute."""

    source: str
    artifacts: str
    friendly: str = ""
    grouping: str = "flat"
    channel: str = "stable"
    max_rows: int = 128
    periodic_scan_seconds: float = 1800
    poll_seconds: float = 5
    lease_seconds: float = 300
    heartbeat_seconds: float = 60
    thumbnail_short_side: int = 0

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            kinds = {"str": (str,), "int": (int,), "float": (int, float)}[f.type]
            if isinstance(value, bool) or not isinstance(value, kinds):
                raise TypeError(f"{f.name} is {f.type}")
        page_limit(self.max_rows, ADAPTER_PAGE)
        if self.grouping not in GROUPINGS:
            raise ValueError(f"grouping is one of {sorted(GROUPINGS)}")
        for name in ("periodic_scan_seconds", "poll_seconds", "lease_seconds", "heartbeat_seconds"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} is positive")
        if self.heartbeat_seconds >= self.lease_seconds:
            raise ValueError("the heartbeat is shorter than the lease")

    @property
    def projects(self) -> bool:
        """Whether friendly paths are kept at all."""
        return bool(self.friendly)


def substitute(value, environment=None):
    """value with placeholders filled in, at any depth; a missing name is an error."""
    environment = os.environ if environment is None else environment
    if isinstance(value, str):
        return _PLACEHOLDER.sub(lambda m: environment[m[1]], value)
    if isinstance(value, list):
        return [substitute(x, environment) for x in value]
    if isinstance(value, dict):
        return {k: substitute(x, environment) for k, x in value.items()}
    return value


def load_config(path: str, environment=None) -> Config:
    with open(path, encoding="utf-8") as f:
        found = substitute(json.load(f), environment)
    if not isinstance(found, dict):
        raise TypeError("a configuration is an object")
    unknown = set(found) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return Config(**found)


def ensure_paths(config: Config) -> None:
    """The source must exist; artifact and friendly folders are made, and must lie apart."""
    if not os.path.isdir(config.source):
        raise FileNotFoundError(config.source)
    made = [config.artifacts] + ([config.friendly] if config.projects else [])
    real = [os.path.realpath(p) for p in [config.source, *made]]
    for i, a in enumerate(real):
        for b in real[i + 1 :]:
            if a == b or a.startswith(b + os.sep) or b.startswith(a + os.sep):
                raise ValueError(f"folders lie within each other: {a}, {b}")
    for p in made:
        os.makedirs(p, exist_ok=True)
