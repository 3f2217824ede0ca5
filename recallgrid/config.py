"""Tuning constants, rewrite rules and taxonomies (frozen, passed to operators as keyword defaults)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

NOW = 1706745600  # the fixed clock of the registered queries: 2024-02-01T00:00:00Z


@dataclass(frozen=True)
class Tuning:
    max_rec_weight: float = 20.0
    max_freq_weight: float = 5.0
    intersection_multiplier: float = 100.0
    salience_multiplier: float = 10.0
    idf_floor: float = 0.1
    expansion_fraction: float = 0.1
    idf_min_count: int = 20
    scan_factor: int = 100
    scan_max: int = 2000
    expansion_threshold: float = 0.65
    expansion_limit: int = 3
    max_proposed_cues: int = 10
    completion_weight: float = 0.1
    completion_top: int = 5
    half_life_s: float = 3600.0
    episode_gap_s: float = 300.0
    episode_overlap: float = 0.5


def layered(*layers: dict, base: Tuning = Tuning()) -> Tuning:
    """Defaults overridden by each layer in turn (file, environment, command line); unknown names are an error."""
    for layer in layers:
        base = replace(base, **layer)
    return base


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class Normalization:
    lowercase: bool = True
    trim: bool = True
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    """None allows everything; a key without an entry in values or prefixes takes any value."""

    keys: tuple[str, ...] | None = None
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prefixes: dict[str, tuple[str, ...]] = field(default_factory=dict)
