"""Defaults, as frozen dataclasses.  Unknown keys are errors; values for each source class are 5-key tables."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

#: fixed values: the source classes in the order of their quotas
CLASSES = ("drone", "actioncam", "phone", "reflex", "generic")


def per_class(drone, actioncam, phone, reflex, generic) -> dict:
    return dict(zip(CLASSES, (drone, actioncam, phone, reflex, generic)))


@dataclass(frozen=True)
class Analysis:
    sample_fps: float = 2.0
    long_side: int = 320
    scene_threshold: float = 0.30
    min_scene_s: float = 1.0
    stability_window: int = 5
    high_fps: float = 100.0
    fallback_fps: float = 25.0
    face_percentile: float = 75.0
    head_s: dict = field(default_factory=lambda: per_class(1.0, 1.0, 0.3, 0.5, 0.5))
    tail_s: dict = field(default_factory=lambda: per_class(1.0, 1.0, 0.3, 0.5, 0.5))


@dataclass(frozen=True)
class Weights:
    sharpness: float = 1.0
    exposure_clipped: float = 0.0
    motion: float = 1.0
    stability: float = 1.0
    colorfulness: float = 0.5
    aesthetic: float = 0.0
    faces: float = 0.0


@dataclass(frozen=True)
class Rules:
    min_height_m: float = 5.0
    min_motion: float = 0.015
    shaky_min_motion: float = 0.04
    min_stability: float = 0.71
    max_clipped: float = 0.05
    min_segment_s: float = 1.5


@dataclass(frozen=True)
class Selection:
    target_s: float = 3.0
    max_clips: int = 40
    per_file: dict = field(default_factory=lambda: per_class(1, 3, 1, 2, 1))
    min_share: dict = field(default_factory=lambda: per_class(0.0, 0.0, 0.0, 0.0, 0.0))
    diversity: float = 0.6
    per_cluster: int = 2
    gap_s: float = 60.0
    cluster_threshold: float = 0.75
    per_visit: int = 3
    tag_share: float = 0.5
    candidate_share: float = 0.5


@dataclass(frozen=True)
class Durations:
    base_s: dict = field(default_factory=lambda: per_class(4.0, 2.0, 2.5, 3.0, 3.0))
    min_s: float = 1.5
    max_s: float = 6.0
    score_low: float = 0.8
    score_high: float = 1.2
    hero_share: float = 0.1
    hero_factor: float = 1.5
    alternate: bool = True
    shorter: float = 0.75
    longer: float = 1.25


@dataclass(frozen=True)
class Places:
    radius_m: float = 150.0
    visit_gap_s: float = 7200.0


@dataclass(frozen=True)
class Similarity:
    visual: float = 0.5
    semantic: float = 0.5
    spatial: float = 0.2
    temporal: float = 0.2
    motion: float = 0.1
    radius_m: float = 200.0
    radius_s: float = 600.0
    semantic_floor: float = 0.5
    hash_share: float = 0.5
    face_guard: bool = True


@dataclass(frozen=True)
class Snapping:
    reach_s: float = 0.5
    max_loss: float = 0.05


@dataclass(frozen=True)
class Tags:
    logit_scale: float = 10.0
    threshold: float = 0.2
    most: int = 3


@dataclass(frozen=True)
class Soundtrack:
    variants: int = 3
    bpm_tolerance: float = 3.0
    multiples: tuple = (2, 4, 6, 8, 12, 16)
    low_energy: float = 0.34
    high_energy: float = 0.67
    morning: tuple = (5, 9)
    daytime: tuple = (9, 17)
    evening: tuple = (17, 21)
    default_row: str = "upbeat folk"


@dataclass(frozen=True)
class Export:
    width: int = 3840
    height: int = 2160
    fallback_fps: float = 25.0
    slow_motion: dict = field(default_factory=lambda: per_class(False, True, False, False, False))
    vertical: str = "exclude"


@dataclass(frozen=True)
class Config:
    analysis: Analysis = Analysis()
    weights: Weights = Weights()
    rules: Rules = Rules()
    selection: Selection = Selection()
    durations: Durations = Durations()
    places: Places = Places()
    similarity: Similarity = Similarity()
    snapping: Snapping = Snapping()
    tags: Tags = Tags()
    soundtrack: Soundtrack = Soundtrack()
    export: Export = Export()


def merged(config, changes: dict):
    """``config`` with nested ``changes``; a key that it does not know, or a class that does not exist, is an error."""
    known = {f.name for f in fields(config)}
    if unknown := set(changes) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = {}
    for key, value in changes.items():
        old = getattr(config, key)
        if is_dataclass(old):
            out[key] = merged(old, value)
        elif isinstance(old, dict):
            if extra := set(value) - set(CLASSES):
                raise ValueError(f"unknown classes: {sorted(extra)}")
            out[key] = old | value
        else:
            out[key] = tuple(value) if isinstance(old, tuple) else value
    return replace(config, **out)


def load(path: str | None, profile: str | None = None) -> Config:
    """Defaults under a TOML file's values and those of one of its profiles; no file gives the defaults."""
    if path is None or not Path(path).exists():
        return Config()
    with open(path, "rb") as f:
        values = tomllib.load(f)
    profiles = values.pop("profiles", {})
    config = merged(Config(), values)
    return merged(config, profiles[profile]) if profile else config
