"""Settings of the command lines: defaults, JSON (or YAML, where that library is there) files over them, and merging."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


def load_config(path: str | Path) -> dict[str, Any]:
    """The settings of a file; FileNotFoundError without one."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def save_config(config: dict[str, Any], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def merge_configs(default: dict[str, Any], user: dict[str, Any]) -> dict[str, Any]:
    """The default with the user's values over it, dictionary by dictionary."""
    out = dict(default)
    for k, v in user.items():
        out[k] = merge_configs(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


class _Config:
    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict[str, Any]):
        """Keys that aren't settings are left out."""
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    @classmethod
    def from_file(cls, path: str | Path):
        return cls.from_dict(load_config(path))


@dataclass
class ModelConfig(_Config):
    features: list[str] = field(default_factory=list)
    target: str = "value"
    n_features: int = 500
    cv_folds: int = 5
    ridge: float = 1e-6
    seed: int = 42


@dataclass
class ActiveLearningConfig(_Config):
    acquisition: str = "expected_improvement"
    kernel: str = "matern52"
    batch_size: int = 10
    n_rounds: int = 5
    minimize: bool = False
    seed: int = 42


@dataclass
class SynthesisConfig(_Config):
    weights: dict[str, float] = field(default_factory=lambda: {"steps": 0.25, "convergence": 0.15, "availability": 0.30, "accessibility": 0.25, "cost": 0.05})
    max_steps: int = 10


@dataclass
class EvaluationConfig(_Config):
    test_size: float = 0.15
    valid_size: float = 0.15
    split: str = "random"
    confidence: float = 0.95
    n_bootstrap: int = 1000
    seed: int = 42
