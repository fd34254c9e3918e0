"""Settings of an approximate run, in one frozen object that is checked once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class Variance(str, Enum):
    """How the variance within a cluster is known."""

    PROPORTION = "proportion"
    MEASURED = "measured"
    WORST_CASE = "worst_case"


@dataclass(frozen=True)
class ApproxConf:
    """ratio: one record of so many is processed. keep_fraction: the share of clusters that run at all.

    precise: no sampling, no dropping, no range. seed None: every block's offset is `offset` modulo its ratio;
    otherwise offsets and the order of clusters are drawn from the seed. exact_s2: the measured variance is not
    cut to an integer. null_key: add the row that bounds keys never seen.
    """

    ratio: int = 1
    keep_fraction: float = 1.0
    confidence: float = 0.95
    precise: bool = False
    seed: int | None = 1
    offset: int = 0
    max_per_cluster: int | None = None
    target_error: float = 0.01
    adaptive_dropping: bool = False
    adaptive_sampling: bool = False
    progressive: bool = False
    hard_drop: bool = False
    variance: Variance = Variance.PROPORTION
    exact_s2: bool = False
    null_key: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "ratio", max(1, int(self.ratio)))
        object.__setattr__(self, "variance", Variance(self.variance))
        if not 0 <= self.keep_fraction <= 1:
            raise ValueError("keep_fraction is a share, from 0 to 1")
        if not 0 < self.confidence < 1:
            raise ValueError("confidence lies between 0 and 1")
        if self.target_error < 0:
            raise ValueError("target_error can't be negative")
        if self.max_per_cluster is not None and self.max_per_cluster < 0:
            raise ValueError("max_per_cluster can't be negative")
        if self.precise and (self.ratio > 1 or self.keep_fraction < 1 or self.progressive or self.adaptive):
            raise ValueError("a precise run has no sampling, dropping, waves or adaptive control")

    @property
    def adaptive(self) -> bool:
        return self.adaptive_dropping or self.adaptive_sampling

    def with_(self, **changes) -> ApproxConf:
        return replace(self, **changes)
