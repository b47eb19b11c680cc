"""Settings of the jobs, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# Names and defaults of parameters that must stay as they are.
METRICS = ("l2", "dot", "cosine")
POOLING = ("mean", "max", "first", "last")
TARGET_POSITIONS = ("first", "diagonal", None)

TOP_K = 20
NPROBE = 8

#: Share of the exact neighbours that a probing search should find where the number of probes is chosen for it.
RECALL = 0.9


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class SplitConfig:
    train_prop: float = 0.8
    val_prop: float = 0.2

    def __post_init__(self) -> None:
        _need(0 < self.train_prop < 1, "train_prop must lie between 0 and 1")
        _need(0 <= self.val_prop <= 1, "val_prop must lie in [0, 1]")


@dataclass(frozen=True)
class SequenceConfig:
    max_seq_length: int = 32
    pos_lookahead: int = 0
    batch_size: int = 32
    seed: int = 0

    def __post_init__(self) -> None:
        _need(self.max_seq_length > 0, "max_seq_length must be positive")
        _need(self.pos_lookahead >= 0, "pos_lookahead must not be negative")
        _need(self.batch_size > 0, "batch_size must be positive")


@dataclass(frozen=True)
class EncoderConfig:
    max_seq_length: int = 32
    pooling: str = "mean"
    normalize: bool = False

    def __post_init__(self) -> None:
        _need(self.max_seq_length > 0, "max_seq_length must be positive")
        _need(self.pooling in POOLING, f"pooling must be one of {POOLING}")


@dataclass(frozen=True)
class IndexConfig:
    id_col: str = "item_id"
    text_col: str = "item_text"
    embedding_col: str = "embedding"
    metric: str = "cosine"

    def __post_init__(self) -> None:
        _need(self.metric in METRICS, f"metric must be one of {METRICS}")


@dataclass(frozen=True)
class LossConfig:
    target_position: str | None = "first"
    mask_false_negatives: bool = True
    num_hard_negatives: int = 0
    scale: float = 1.0
    margin: float = 0.5

    def __post_init__(self) -> None:
        _need(
            self.target_position in TARGET_POSITIONS,
            f"target_position must be one of {TARGET_POSITIONS}",
        )
