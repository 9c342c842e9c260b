"""Settings of sources and targets, validated and clamped."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from treeflow.dims import TIERS


def _known(cls, values: dict) -> dict:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in values.items() if k in names}


@dataclass
class Target:
    path: str
    profile: str = "auto"
    workers: int = 4

    def __post_init__(self):
        if self.profile not in TIERS:
            raise ValueError(f"unknown profile: {self.profile}")
        self.workers = min(max(int(self.workers), 1), 64)


@dataclass
class Source:
    path: str
    targets: list[Target] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class Config:
    sources: list[Source] = field(default_factory=list)
    buffer_mib: int = 512
    max_versions: int = 24
    max_version_bytes: int = 1 << 30

    def __post_init__(self):
        self.buffer_mib = min(max(int(self.buffer_mib), 16), 65_536)

    @classmethod
    def parse(cls, text: str) -> Config:
        raw = tomllib.loads(text)
        sources = [
            Source(**{**_known(Source, s), "targets": [Target(**_known(Target, t)) for t in s.get("targets", [])]}) for s in raw.get("sources", [])
        ]
        return cls(**{**_known(cls, raw), "sources": sources})
