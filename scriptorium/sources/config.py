"""Stage configurations: YAML or plain mappings with a runtime overlay, and pipe-free defaults for missing keys."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass
class StageConfig:
    """What a build needs to know; unknown keys are kept aside."""

    stage: str = "build"
    profile: str = ""
    bundles: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    allow_watchlist: bool = False
    source_limits: dict[str, int] = field(default_factory=dict)
    shard_target_mb: int = 256
    max_active_sources: int = 4
    output_root: str = "runs"
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, stage: dict[str, Any], runtime: dict[str, Any] | None = None) -> StageConfig:
        known = {f.name for f in fields(cls)} - {"extra"}
        merged = {**stage, **(runtime or {})}
        return cls(**{k: v for k, v in merged.items() if k in known and v is not None}, extra={k: v for k, v in merged.items() if k not in known})

    @classmethod
    def from_yaml(cls, stage_path: str, runtime_path: str | None = None) -> StageConfig:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs the yaml package") from error

        def load(path: str | None) -> dict[str, Any]:
            return (yaml.safe_load(Path(path).read_text()) or {}) if path else {}

        return cls.from_mapping(load(stage_path), load(runtime_path))

    def limit(self, source_id: str, default: int) -> int:
        return self.source_limits.get(source_id, default)
