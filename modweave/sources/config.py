"""Configuration: TOML, every field optional, unknown fields refused."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    """The configuration cannot be read."""


@dataclass
class Barrel:
    reexport_ratio: float = 0.8
    max_own_decls: int = 2


@dataclass
class Thresholds:
    max_amplification: float = 5.0
    max_cycles: int = 0


@dataclass
class Codemod:
    import_style: str = "preserve"  # or alias, relative


@dataclass
class Resolve:
    conditions: list[str] = field(default_factory=list)


@dataclass
class Config:
    entrypoints: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    barrel: Barrel = field(default_factory=Barrel)
    thresholds: Thresholds = field(default_factory=Thresholds)
    codemod: Codemod = field(default_factory=Codemod)
    resolve: Resolve = field(default_factory=Resolve)


def _filled(kind, values: dict, where: str):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ConfigError(f"unknown field {where}{unknown[0]}")
    inner = {"barrel": Barrel, "thresholds": Thresholds, "codemod": Codemod, "resolve": Resolve}
    return kind(**{k: _filled(inner[k], v, f"{where}{k}.") if k in inner and isinstance(v, dict) else v for k, v in values.items()})


def load(path: str | None, default: str | None = None) -> Config:
    """The configuration at ``path``, or at ``default`` if that exists; a missing ``path`` is an error."""
    file = Path(path or default or "")
    if not file.is_file():
        if path is not None:
            raise ConfigError(f"no configuration at {path}")
        return Config()
    try:
        return _filled(Config, tomllib.loads(file.read_text()), "")
    except (tomllib.TOMLDecodeError, TypeError) as problem:
        raise ConfigError(str(problem)) from problem
