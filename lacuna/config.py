"""Settings of the engine: script profiles, thresholds, bounded overrides and YAML files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from lacuna.functions.script import Script


@dataclass(frozen=True)
class Profile:
    """How texts of a script are matched. seed is the length of the grams in the index, decisive that of a full match."""

    name: str
    seed: int
    min_window: int
    max_window: int
    decisive: int
    clause: str
    max_windows: int = 400
    hits_per_window: int = 20
    max_readings: int = 12
    all_readings: int = 24
    query_terms: int = 24
    hits_per_term: int = 400
    #: a conversion by phrases that comes before folding, for ideographs; without one, the seed of pairs
    script: Script | None = None


HAN = Profile("han", seed=4, min_window=4, max_window=12, decisive=5, clause="[，。！？；]")
LETTERS = Profile("letters", seed=8, min_window=12, max_window=20, decisive=14, clause=r"[\n.!?;]")


@dataclass(frozen=True)
class Thresholds:
    verify: float = 0.6
    noise: float = 0.35
    windows: int = 2
    overlap: float = 0.15


@dataclass(frozen=True)
class Settings:
    """Run-time settings; every number has bounds."""

    fuse_top: int = 50
    top_k: int = 8
    rrf_k: int = 60
    max_windows: int = 400
    max_readings: int = 12
    verify_floor: float = 0.6
    noise_floor: float = 0.35
    overlap_floor: float = 0.15
    agent_enabled: bool = False
    skip_without_overlap: bool = True
    max_iterations: int = 6
    max_tool_calls: int = 12
    max_seconds: int = 60
    max_cost_usd: float = 0.5


BOUNDS: dict[str, tuple[float, float]] = {
    "fuse_top": (1, 500),
    "top_k": (1, 50),
    "rrf_k": (1, 1000),
    "max_windows": (1, 5000),
    "max_readings": (1, 24),
    "verify_floor": (0, 1),
    "noise_floor": (0, 1),
    "overlap_floor": (0, 1),
    "max_iterations": (1, 100),
    "max_tool_calls": (1, 1000),
    "max_seconds": (1, 3600),
    "max_cost_usd": (0, 100),
}


class ConfigError(ValueError):
    """All that is wrong with a configuration, one issue a line."""


def override(base: Settings, changes: Mapping[str, Any] | None) -> Settings:
    """Settings with some values changed; unknown names, wrong types and values out of bounds are all reported."""
    known = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    issues, accepted = [], {}
    for name, value in (changes or {}).items():
        if value is None:
            continue
        if name not in known:
            issues.append(f"{name}: unknown setting")
        elif known[name] is bool:
            if not isinstance(value, bool):
                issues.append(f"{name}: must be true or false")
            accepted[name] = value
        elif isinstance(value, bool) or not isinstance(value, int | float) or (known[name] is int and value != int(value)):
            issues.append(f"{name}: must be a {'whole ' if known[name] is int else ''}number")
        elif not BOUNDS[name][0] <= value <= BOUNDS[name][1]:
            issues.append(f"{name}: must be from {BOUNDS[name][0]:g} to {BOUNDS[name][1]:g}")
        else:
            accepted[name] = known[name](value)
    if issues:
        raise ConfigError("\n".join(issues))
    return replace(base, **accepted)


def load_settings(path: str, base: Settings = Settings()) -> Settings:
    """Settings from a YAML mapping."""
    found = _yaml(path)
    if found is not None and not isinstance(found, Mapping):
        raise ConfigError(f"{path}: must hold a mapping")
    return override(base, found)


def load_prices(path: str) -> list[tuple[str, float, float, float | None]]:
    """(model, input, output, cached input) in USD for a million tokens, from a YAML mapping `models`."""
    found = _yaml(path)
    models = found.get("models", {}) if isinstance(found, Mapping) else None
    if not isinstance(models, Mapping):
        raise ConfigError(f"{path}: must hold a mapping `models`")
    rows, issues = [], []
    for name, price in models.items():
        values = [price.get(k) if isinstance(price, Mapping) else None for k in ("inputPerMTok", "outputPerMTok", "cachedInputPerMTok")]
        if any(v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or v < 0) for v in values) or None in values[:2]:
            issues.append(f"{name}: prices must be numbers of 0 or more")
        else:
            rows.append((str(name), float(values[0]), float(values[1]), None if values[2] is None else float(values[2])))
    if issues:
        raise ConfigError("\n".join(issues))
    return rows


def _yaml(path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as file:
        try:
            return yaml.safe_load(file)
        except yaml.YAMLError as error:
            raise ConfigError(f"{path}: {error}") from error


def as_dict(settings: Settings) -> dict[str, Any]:
    return asdict(settings)
