"""Run configuration from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    d_model: int = 512
    num_encoder_layers: int = 6
    num_heads: int = 8
    d_ff: int = 2048
    num_labels: int = 3
    dropout_rate: float = 0.1
    batch_size: int = 32
    num_epochs: int = 10
    adam_learning_rate: float = 1e-4
    adam_beta1: float = 0.9
    adam_beta2: float = 0.999
    adam_epsilon: float = 1e-8
    adam_weight_decay: float = 0.0
    num_threads: int = 4
    cwt_scales: tuple[float, ...] = (2.0, 4.0, 8.0, 16.0, 32.0)
    window_size: int = 5000
    window_overlap: int = 1000
    train_fasta: str | None = None
    train_gff: str | None = None
    predict_fasta: str | None = None
    output_gff: str | None = None
    output_bedgraph: str | None = None
    model_path: str | None = None

    def checked(self) -> Config:
        if self.d_model <= 0 or self.num_heads <= 0 or self.d_model % self.num_heads:
            raise ValueError("d_model and num_heads must be positive, and num_heads a divisor of d_model")
        return self


#: TOML section and key of each field; the later of two places of one field wins.
PLACES = (
    ("model", "d_model", "d_model"),
    ("model", "num_encoder_layers", "num_encoder_layers"),
    ("model", "num_heads", "num_heads"),
    ("model", "d_ff", "d_ff"),
    ("training", "dropout_rate", "dropout_rate"),
    ("training", "batch_size", "batch_size"),
    ("training", "num_epochs", "num_epochs"),
    ("training", "adam_beta1", "adam_beta1"),
    ("training", "adam_beta2", "adam_beta2"),
    ("training", "adam_epsilon", "adam_epsilon"),
    ("adam", "learning_rate", "adam_learning_rate"),
    ("adam", "beta1", "adam_beta1"),
    ("adam", "beta2", "adam_beta2"),
    ("adam", "epsilon", "adam_epsilon"),
    ("adam", "weight_decay", "adam_weight_decay"),
    ("parallel", "num_threads", "num_threads"),
    ("sliding_window", "window_size", "window_size"),
    ("sliding_window", "window_overlap", "window_overlap"),
    ("paths", "train_fasta", "train_fasta"),
    ("paths", "train_gff", "train_gff"),
    ("paths", "predict_fasta", "predict_fasta"),
    ("paths", "output_gff", "output_gff"),
    ("paths", "output_bedgraph", "output_bedgraph"),
    ("paths", "model_path", "model_path"),
)
#: What a verb can't do without.
REQUIRED = {"train": ("train_fasta", "train_gff", "model_path"), "predict": ("predict_fasta", "model_path", "output_gff")}


def _scales(values: list) -> tuple[float, ...]:
    """A value that isn't a number becomes twice its place, from 1."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return tuple(float(v) if number(v) else 2.0 * (i + 1) for i, v in enumerate(values))


def parse_config(text: str) -> Config:
    """Defaults, overridden by the values of the right type; a value of another type is ignored."""
    found, data = {}, tomllib.loads(text)
    kinds = {f.name: f.type for f in fields(Config)}
    for section, key, name in PLACES:
        value = data.get(section, {}).get(key) if isinstance(data.get(section, {}), dict) else None
        kind = kinds[name]
        if kind == "int" and isinstance(value, int) and not isinstance(value, bool):
            found[name] = value
        elif kind == "float" and isinstance(value, (int, float)) and not isinstance(value, bool):
            found[name] = float(value)
        elif kind == "str | None" and isinstance(value, str):
            found[name] = value
    scales = data.get("cwt", {}).get("scales")
    if isinstance(scales, list) and scales:
        found["cwt_scales"] = _scales(scales)
    return replace(Config(), **found).checked()


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text())


def require(config: Config, verb: str) -> None:
    missing = [name for name in REQUIRED[verb] if not getattr(config, name)]
    if missing:
        raise ValueError(f"{verb} needs the paths {', '.join(missing)}")
