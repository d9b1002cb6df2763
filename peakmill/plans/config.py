"""All parameters of a run in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are what a user of the launcher gets. compat keeps the deterministic oddities of older results."""

    k: int = 31
    min_abundance: int | None = None
    percentile: float = 95.0
    control_scale: float = 0.99
    min_abundance_mapping: int = 10
    identity: float = 90.0
    expect: float = 1e-6
    max_bubble: int | None = None
    states: int = 5
    pvalue: float = 0.1
    absolute_minimum: float = 10.0
    filtering_fraction: float | None = None
    partner_threshold: float = 0.1
    widen: int = 5
    store_low: bool = True
    compat: bool = False
    unwrap: bool = False

    def __post_init__(self) -> None:
        if not 2 <= self.states <= 7:
            raise ValueError("states must be 2 to 7")
        if self.k < 3:
            raise ValueError("k must be at least 3")

    @property
    def bubble_length(self) -> int:
        return self.k if self.max_bubble is None else self.max_bubble
