"""Settings of a run, from TOML (S13): unknown keys and values out of range are errors."""

from __future__ import annotations

import dataclasses
import math
import os
import tomllib
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Speech:
    window_seconds: float = 28.0
    overlap_seconds: float = 4.0
    padding_seconds: float = 0.35
    merge_gap_seconds: float = 0.9


@dataclasses.dataclass(frozen=True)
class Alignment:
    batch_items: int = 4
    padded_seconds: float = 80.0


@dataclasses.dataclass(frozen=True)
class Output:
    width: int = 1920
    height: int = 1080
    fps: int = 30
    segment_seconds: float = 300.0
    silence_threshold: float = 5.0


@dataclasses.dataclass(frozen=True)
class Settings:
    data_root: str = "data"
    speech: Speech = dataclasses.field(default_factory=Speech)
    alignment: Alignment = dataclasses.field(default_factory=Alignment)
    output: Output = dataclasses.field(default_factory=Output)

    def __post_init__(self):
        for part in (self.speech, self.alignment, self.output):
            for name, value in dataclasses.asdict(part).items():
                least_open = name not in ("overlap_seconds", "padding_seconds", "merge_gap_seconds")
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0 or (least_open and value == 0):
                    raise ValueError(f"{name} must be a finite {'positive' if least_open else 'non-negative'} number")
        if self.speech.overlap_seconds >= self.speech.window_seconds:
            raise ValueError("overlap_seconds must be less than window_seconds")

    def fields(self) -> dict:
        """What a fingerprint covers."""
        return dataclasses.asdict(self)


def _filled(kind, given: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**given)


def from_mapping(raw: dict, base: Path | None = None) -> Settings:
    raw = dict(raw)
    for name, kind in (("speech", Speech), ("alignment", Alignment), ("output", Output)):
        if name in raw:
            raw[name] = _filled(kind, raw[name])
    if "data_root" in raw:
        path = Path(os.path.expandvars(raw["data_root"])).expanduser()
        raw["data_root"] = str(path if path.is_absolute() or base is None else base / path)
    return _filled(Settings, raw)


def load(path: str | Path) -> Settings:
    path = Path(path)
    return from_mapping(tomllib.loads(path.read_text()), path.parent)
