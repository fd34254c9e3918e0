"""How many clusters to run, and at which ratio, to meet a target error in the least predicted time. Driver arithmetic only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from plusminus.functions.stats import t_quantile

MOST_RATIO = 10_000


@dataclass(frozen=True)
class TimeModel:
    """Seconds of one cluster: base + per_read * records + per_processed * records / ratio (defaults are fixed values)."""

    base: float = 3.0
    per_read: float = 8e-6
    per_processed: float = 8e-6

    def seconds(self, records: float, ratio: float) -> float:
        return self.base + self.per_read * records + self.per_processed * records / ratio


def fit_time(times: Sequence[float], read: Sequence[float], processed: Sequence[float]) -> TimeModel:
    """The model of measured clusters: least squares over more than three of them with all coefficients above zero, else
    the default base with the rest shared over records read and processed."""
    t, m_all, m = (np.array(x, float) for x in (times, read, processed))
    if not len(t):
        return TimeModel()
    t, m = _more_variety(t, m_all, m)
    if len(t) > 3:
        found = np.linalg.lstsq(np.stack([m_all, m, np.ones(len(t))], 1), t, rcond=None)[0]
        if (found > 0).all():
            return TimeModel(float(found[2]), float(found[0]), float(found[1]))
    each = max(0.0, (t.mean() - 3.0)) / max(m_all.mean() + m.mean(), 1.0)
    return TimeModel(3.0, each, each)


def _more_variety(t: np.ndarray, m_all: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """If over 66 % of the points processed all they read, leading such points count as half the time for one record."""
    t, m = t.copy(), m.copy()
    for i in range(len(t)):
        if (m == m_all).mean() <= 0.66:
            break
        if m[i] == m_all[i]:
            t[i], m[i] = t[i] / 2, 1
    return t, m


@dataclass(frozen=True)
class Known:
    """What is known of the key that decides, from n1 of n_all clusters: estimate, variance of blown-up totals, variance
    within that is already there, mean records of a cluster and mean variance within a record."""

    n_all: int
    tau: float
    s2: float
    records: float
    s2avg: float
    n1: int = 0
    var2: float = 0.0


def predicted_error(known: Known, n2: int, ratio: float, confidence: float = 0.95) -> float:
    """The relative error, in percent, after n2 more clusters at a ratio."""
    n = known.n1 + n2
    if n < 1 or known.tau <= 0:
        return math.inf
    between = known.n_all * (known.n_all - n) * known.s2 / n
    inside = known.n_all / n * (known.var2 + n2 * known.records * (ratio - 1) * known.s2avg)
    return 100 * t_quantile(n - 1, confidence) * math.sqrt(max(0.0, between + inside)) / known.tau


@dataclass(frozen=True)
class Plan:
    seconds: float
    clusters: int
    ratio: int
    reachable: bool = True


def largest_ratio(known: Known, n2: int, target: float, confidence: float = 0.95, most: int | None = None) -> int:
    """The largest ratio whose predicted error meets the target; 0 if not even 1 does.

    most: MOST_RATIO at most, and by default so small that a cluster gives two records on average, as the variance within
    can't be told from one.
    """
    most = min(MOST_RATIO, max(1, int(known.records // 2))) if most is None else most
    if predicted_error(known, n2, 1, confidence) > target:
        return 0
    low, high = 1, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if predicted_error(known, n2, mid, confidence) <= target else (low, mid - 1)
    return low


def cheapest(known: Known, target: float, model: TimeModel, confidence: float = 0.95, compat: bool = False) -> Plan:
    """The fastest (clusters, ratio) whose predicted error is at most target percent.

    Every feasible number of further clusters up to all of them is looked at, until even the largest ratio would be
    slower than the best. If nothing is feasible the plan is to run all at ratio 1, marked as not reachable. compat:
    starts at the last infeasible number, takes ratio 1 there unchecked, and never tries all.
    """
    left = known.n_all - known.n1
    if left <= 0:
        return Plan(0.0, known.n_all, 1)
    low, high = 0, left + 1  # predicted error at ratio 1 falls with the number of clusters
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if predicted_error(known, mid, 1, confidence) <= target else (mid, high)
    best: Plan | None = None
    for n2 in range(low if compat else high, left if compat else left + 1):
        if best and n2 * model.seconds(known.records, MOST_RATIO) >= best.seconds:
            break
        ratio = largest_ratio(known, n2, target, confidence, MOST_RATIO if compat else None) or (1 if compat else 0)
        if ratio:
            seconds = n2 * model.seconds(known.records, ratio)
            if best is None or seconds < best.seconds:
                best = Plan(seconds, known.n1 + n2, ratio)
    return best or Plan(left * model.seconds(known.records, 1), known.n_all, 1, False)


def ratio_for_all(known: Known, target: float, confidence: float = 0.95) -> int:
    """The largest ratio, in closed form, if all clusters run; from 1 to MOST_RATIO. target is a share, not percent."""
    inside = (known.n_all - known.n1) * known.records * known.s2avg
    if inside <= 0:
        return MOST_RATIO
    room = (target * known.tau / t_quantile(known.n_all - 1, confidence)) ** 2 - known.var2
    return int(min(MOST_RATIO, max(1, round(room / inside + 1))))
