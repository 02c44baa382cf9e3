"""Configuration of experiments: the interface's names and defaults, and its limits."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, field

BACKENDS = ("ricci_ollivier", "ollivier", "forman", "auto")


def _warned(value: float, most: float, what: str) -> None:
    if value > most:
        warnings.warn(f"{what} = {value} is unusually large", stacklevel=4)


# Names, defaults and limits below are the interface that must match.
@dataclass
class EncoderConfig:
    model_name: str = "sentence-transformers/all-MiniLM-L6-v2"
    mode: str = "dual"
    normalize: bool = True

    def __post_init__(self):
        if self.mode not in ("dual", "mono"):
            raise ValueError(f"mode must be 'dual' or 'mono', not {self.mode!r}")


@dataclass
class TrainerConfig:
    epochs: int = 1
    batch_size: int = 16
    lr: float = 2e-5
    verbose: bool = False
    k_graph: int = 10
    geodesic: bool = False
    lambda_ricci: float = 0.0
    lambda_forman: float = 0.0
    kappa_target: float = 0.0
    ricci_backend: str = "ricci_ollivier"

    def __post_init__(self):
        if self.k_graph < 5:
            raise ValueError("k_graph must be 5 at least")
        if self.lambda_ricci < 0 or self.lambda_forman < 0:
            raise ValueError("lambdas must not be negative")
        if self.lr <= 0:
            raise ValueError("lr must be positive")
        if self.ricci_backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.ricci_backend!r}")
        _warned(self.k_graph, 100, "k_graph")
        _warned(self.lambda_ricci, 10, "lambda_ricci")
        _warned(self.lambda_forman, 10, "lambda_forman")
        _warned(self.lr, 0.1, "lr")

    @property
    def mode(self) -> str:
        return "classic" if self.lambda_ricci == self.lambda_forman == 0 else "geometric"

    @staticmethod
    def gamma(epoch: int) -> float:
        return max(0.05, 0.2 * 0.95**epoch)


@dataclass
class ExperimentConfig:
    dataset: str = ""
    dry_run: bool = False
    output_dir: str = "runs"
    device: str | None = None
    encoder: EncoderConfig = field(default_factory=EncoderConfig)
    trainer: TrainerConfig = field(default_factory=TrainerConfig)

    @classmethod
    def from_dict(cls, values: dict) -> ExperimentConfig:
        if unknown := set(values) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown keys {sorted(unknown)}")
        values = dict(values)
        for name, kind in (("trainer", TrainerConfig), ("encoder", EncoderConfig)):
            if isinstance(values.get(name), dict):
                if unknown := set(values[name]) - set(kind.__dataclass_fields__):
                    raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
                values[name] = kind(**values[name])
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> ExperimentConfig:
        """A local file; an empty one gives the defaults."""
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
        if not isinstance(values, dict):
            raise ValueError(f"{path} holds no mapping")
        return cls.from_dict(values)

    def to_dict(self) -> dict:
        return asdict(self)
