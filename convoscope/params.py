"""Tunable thresholds, all in one frozen value that plans carry around."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Behavioural thresholds (seconds unless named otherwise).
    reply_window: int = 86_400
    turn_window: int = 21_600
    session_gap: int = 21_600
    uptake_window: int = 3_600
    active_window: int = 7_200
    last_word_gap: int = 10_800
    silence: int = 172_800
    collision: int = 30
    burst_floor: int = 3
    page_size: int = 25
    diversity_window: int = 500
    monthly_above_days: int = 180

    #: Rows one task may hold of one ordered group. A chat above it is cut into
    #: slices; a key above it is salted. It never changes a result.
    rows_per_slice: int = 2_000_000
    #: Token positions per task when vocabulary windows are counted.
    tokens_per_bucket: int = 200_000

    def __post_init__(self) -> None:
        for name in ("rows_per_slice", "tokens_per_bucket", "diversity_window", "page_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


DEFAULT = Params()
