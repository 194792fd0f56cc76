"""Declarative pipeline configuration: validated, canonical, content-addressed."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from corpusloom.operators.clean import MINIMUM
from corpusloom.operators.dedup import lsh_dimensions


@dataclass(frozen=True)
class Source:
    name: str
    reader: str
    path: str
    profile: str
    license: str | None = None
    domain: str = "general"


@dataclass(frozen=True)
class Bucket:
    """Target tokens of a bucket, its selector and the weights of its sources (summing to 1)."""

    name: str
    selector: str
    target_tokens: int
    weights: dict[str, float]


@dataclass(frozen=True)
class Pipeline:
    sources: tuple[Source, ...]
    buckets: tuple[Bucket, ...]
    priority: tuple[str, ...]
    seed: int = 20
    oversample: float = 1.2
    minhash: dict[str, tuple[int, float]] = field(default_factory=lambda: {"zh": (14, 0.8), "en": (14, 0.8), "code": (14, 0.85)})

    def validate(self) -> Pipeline:
        """Raise ValueError on unknown sources, profiles or buckets, weights that do not sum to 1, or impossible thresholds."""
        names = {s.name for s in self.sources}
        if len(names) != len(self.sources):
            raise ValueError("a source is named twice")
        for s in self.sources:
            if s.profile not in MINIMUM:
                raise ValueError(f"unknown profile {s.profile}")
        for b in self.buckets:
            if set(b.weights) - names:
                raise ValueError(f"unknown sources in {b.name}: {sorted(set(b.weights) - names)}")
            if abs(sum(b.weights.values()) - 1) > 1e-6:
                raise ValueError(f"weights of {b.name} do not sum to 1")
        if set(self.priority) - {b.name for b in self.buckets}:
            raise ValueError("priority names an unknown bucket")
        for bands, threshold in self.minhash.values():
            lsh_dimensions(bands, threshold)
        return self


def canonical(data) -> str:
    return json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(data) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical(data).encode()).hexdigest()


def run_id(p: Pipeline, manifest: list[dict]) -> str:
    """Names the output directory by configuration and inputs, so another of either never reuses results."""
    return digest({"pipeline": asdict(p), "inputs": sorted(canonical(m) for m in manifest)})[:12]


def check_identity(recorded: dict, now: dict) -> None:
    """Raise ValueError naming the parts of a stage's identity that changed since they were recorded."""
    stale = sorted(k for k in recorded.keys() | now.keys() if recorded.get(k) != now.get(k))
    if stale:
        raise ValueError(f"stale: {', '.join(stale)}")
