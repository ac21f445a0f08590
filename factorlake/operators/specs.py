"""What names a model."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelSpec:
    kind: str
    params: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return ":".join([self.kind, *[f"{k}={v}" for k, v in sorted(self.params.items())]])
