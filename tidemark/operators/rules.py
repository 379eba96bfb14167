"""Detector rules for one value against a gated baseline.

These run inside the fold, where each decision feeds the next row's baseline
and a column expression cannot be used.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable

import numpy as np

DEPTH = 30
MIN_OBSERVATIONS = 3
MAD_NORMAL = 1.4826
US_PER_HOUR = 3_600_000_000


def median_of(ordered: list[float]) -> float:
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


class Baseline:
    """Accepted prices of one series plus change and flag tracking."""

    __slots__ = (
        "prices", "last_price", "last_change", "unchanged", "held_price", "held_since", "_memo",
    )

    def __init__(self, prices=(), last_price=None, last_change=None, unchanged=0,
                 held_price=None, held_since=None):
        self.prices = list(prices)[-DEPTH:]
        self.last_price = last_price
        self.last_change = last_change
        self.unchanged = unchanged
        self.held_price = held_price
        self.held_since = held_since
        self._memo = {}

    def copy(self) -> Baseline:
        """The same prices and flags, with what was computed of them."""
        out = Baseline(*self.snapshot())
        out._memo = dict(self._memo)
        return out

    def snapshot(self) -> tuple:
        return (list(self.prices), self.last_price, self.last_change, self.unchanged,
                self.held_price, self.held_since)

    def _once(self, name: str, compute: Callable[[list[float]], object]):
        if name not in self._memo:
            self._memo[name] = compute(self.prices)
        return self._memo[name]

    def mean_std(self) -> tuple[float, float]:
        # One sum and Welford's squares, in order: the SQL aggregates to the last bit,
        # which decides where a z-score meets a threshold exactly.
        def compute(p):
            total = mean = squares = 0.0
            for n, x in enumerate(p, 1):
                before = mean
                mean += (x - mean) / n
                squares += (x - mean) * (x - before)
                total += x
            if squares == 0.0:
                return p[0], 0.0
            return total / len(p), math.sqrt(squares / (len(p) - 1))
        return self._once("mean_std", compute)

    def ordered(self) -> list[float]:
        return self._once("ordered", sorted)

    def centre(self) -> float:
        return self._once("centre", lambda p: median_of(self.ordered()))

    def mad(self) -> float:
        mid = self.centre()
        return self._once("mad", lambda p: median_of(sorted([abs(x - mid) for x in p])))

    def sn(self) -> float:
        def compute(p):
            n = len(p)
            if n < 8:
                medians = [median_of(sorted([abs(x - y) for y in p])) for x in p]
            else:
                gaps = np.abs(np.subtract.outer(p, p))
                gaps.sort(axis=1)
                medians = ((gaps[:, (n - 1) // 2] + gaps[:, n // 2]) / 2).tolist()
            spread = median_of(sorted(medians))
            return spread * (n / (n - 0.9) if n % 2 else 1.0)
        return self._once("sn", compute)

    def zscore(self, price: float) -> float | None:
        if not self.prices:
            return None
        mean, std = self.mean_std()
        return (price - mean) / std if std > 0 else None

    def change(self, price: float) -> float | None:
        last = self.last_price
        if last is None or last == price or last <= 0:
            return None
        return (price - last) / last

    def _extend(self, price: float, now: int | None) -> None:
        self.prices.append(price)
        if len(self.prices) > DEPTH:
            del self.prices[0]
        self.last_price = price
        self.last_change = now
        self.unchanged = 0
        self._memo = {}

    def accept(self, price: float, now: int | None) -> None:
        """Add an unflagged price; an unchanged one only lengthens its run."""
        if self.last_price is not None and self.last_price == price:
            self.unchanged += 1
        else:
            self._extend(price, now)

    def hold(self, price: float, now: int, tolerance: float) -> None:
        """Start or keep the clock of a flagged price."""
        if self.held_price is None or abs(self.held_price - price) > self.held_price * tolerance:
            self.held_price, self.held_since = price, now

    def released(self, price: float, now: int, tolerance: float, hours: float) -> bool:
        """Whether a held price has lasted long enough; if so it joins the baseline."""
        if self.held_price is None:
            return False
        if abs(self.held_price - price) > self.held_price * tolerance:
            self.held_price = self.held_since = None
            return False
        if (now - self.held_since) / US_PER_HOUR < hours:
            return False
        self._extend(price, now)
        self.held_price = self.held_since = None
        return True


# A rule takes (price, baseline, row) and returns (flagged, score, severity, types, insufficient).
NONE = (False, 0.0, None, "", False)
SHORT = (False, 0.0, None, "", True)


def _bands(value: float, threshold: float, high: float, top: float) -> str:
    if value > threshold * top:
        return "critical"
    if value > threshold * high:
        return "high"
    return "medium"


def _capped(value: float, threshold: float) -> float:
    return min(value / (threshold * 2.0), 1.0)


def measured(rule, kind: tuple, cut: float, reach: Callable):
    """Tell that rules of one ``kind`` flag a row up to some cut.

    ``reach(price, base, cuts, lo, hi)`` is the place in ``cuts`` (ascending) before which, from ``lo`` on, rules with
    these cuts flag the price and from which, up to ``hi``, they do not.
    """
    rule.kind, rule.cut, rule.reach = kind, cut, reach
    return rule


def _below(value: Callable):
    """Reach of rules that flag a value above their cut; None flags nowhere."""
    def reach(price, base, cuts, lo, hi):
        found = value(price, base)
        return lo if found is None else bisect_left(cuts, found, lo, hi)
    return reach


def _abs_zscore(price, base):
    z = base.zscore(price) if len(base.prices) >= MIN_OBSERVATIONS else None
    return None if z is None else abs(z)


def _abs_change(price, base):
    change = base.change(price)
    return None if change is None else abs(change)


def _modified(mode: str, weight: float):
    """The deviation from the median in units of the mode's scale; None without a scale."""
    def value(price, base):
        if len(base.prices) < MIN_OBSERVATIONS:
            return None
        gap = abs(price - base.centre())
        mad = MAD_NORMAL * base.mad() if mode != "sn" else None
        sn = base.sn() if mode != "mad" else None
        if (mad is not None and mad <= 0) or (sn is not None and sn <= 0):
            return None
        if mode == "mad":
            return gap / mad
        if mode == "sn":
            return gap / sn
        if mode == "weighted":
            return weight * (gap / mad) + (1.0 - weight) * (gap / sn)
        if mode == "max":
            return max(gap / mad, gap / sn)
        return 0.5 * (gap / mad + gap / sn)
    return value


def _iqr_distance(price, q1, q3, multiplier):
    spread = q3 - q1
    return max(q1 - multiplier * spread - price, price - (q3 + multiplier * spread))


def _iqr_reach(price, base, cuts, lo, hi):
    n = len(base.prices)
    if n >= 4:
        q1, q3 = base.ordered()[n // 4], base.ordered()[3 * n // 4]
        while lo < hi and not _iqr_distance(price, q1, q3, cuts[lo]) <= 0:
            lo += 1
    return lo


def zscore_rule(threshold: float = 3.0):
    def rule(price, base, row):
        if len(base.prices) < MIN_OBSERVATIONS:
            return SHORT
        z = base.zscore(price)
        if z is None:
            return NONE
        z = abs(z)
        if z > threshold:
            return True, _capped(z, threshold), _bands(z, threshold, 1.5, 2), "price_zscore", False
        return False, _capped(z, threshold), None, "", False
    return measured(rule, ("zscore",), threshold, _below(_abs_zscore))


def modified_rule(mode: str = "mad", threshold: float = 2.0, weight: float = 0.5):
    value = _modified(mode, weight)

    def rule(price, base, row):
        if len(base.prices) < MIN_OBSERVATIONS:
            return SHORT
        z = value(price, base)
        if z is None:
            return NONE
        if z > threshold:
            return True, _capped(z, threshold), _bands(z, threshold, 1.5, 2), "price_zscore", False
        return False, _capped(z, threshold), None, "", False
    return measured(rule, ("modified", mode, weight), threshold, _below(value))


def iqr_rule(multiplier: float = 1.5):
    def rule(price, base, row):
        n = len(base.prices)
        if n < 4:
            return SHORT
        q1, q3 = base.ordered()[n // 4], base.ordered()[3 * n // 4]
        spread = q3 - q1
        distance = _iqr_distance(price, q1, q3, multiplier)
        if distance <= 0:
            return NONE
        if spread <= 0:
            return True, 0.5, None, "price_iqr", False
        return True, _capped(distance, spread), _bands(distance / spread, 1.0, 2, 3), "price_iqr", False
    return measured(rule, ("iqr",), multiplier, _iqr_reach)


def change_rule(threshold: float = 0.20):
    def rule(price, base, row):
        change = base.change(price)
        if change is None:
            return NONE
        change = abs(change)
        if change > threshold:
            return True, _capped(change, threshold), _bands(change, threshold, 2, 3), "price_change", False
        return False, _capped(change, threshold), None, "", False
    return measured(rule, ("change",), threshold, _below(_abs_change))


def row_rule(prefix: str):
    """A stateless detector computed as columns beforehand: reads ``<prefix>_flagged`` and so on."""
    def rule(price, base, row):
        return (bool(row[f"{prefix}_flagged"]), float(row[f"{prefix}_score"]),
                row[f"{prefix}_severity"], row[f"{prefix}_types"] or "", False)
    return rule


def _score_band(score: float) -> str:
    return "critical" if score >= 0.9 else "high" if score >= 0.8 else "medium" if score >= 0.7 else "low"


def model_rule(threshold: float = 0.5):
    """A model's verdict: the fold puts the score against the gated baseline into ``model_score``; None without a model."""
    def rule(price, base, row):
        score = row["model_score"]
        if score is None:
            return SHORT
        if score < threshold:
            return False, score, None, "", False
        z = base.zscore(price) if len(base.prices) >= MIN_OBSERVATIONS else None
        change = base.change(price)
        by_change = abs(z or 0.0) <= 2 and change is not None and abs(change) > 0.2
        return True, score, _score_band(score), "price_change" if by_change else "price_zscore", False
    return rule


def tree_inputs(price: float, list_price: float | None, base: Baseline) -> list[float]:
    """The twelve model inputs against the gated baseline; unknown ones are zero."""
    has_list = list_price is not None
    ratio = price / list_price if has_list and list_price > 0 else 1.0
    head = [price, math.log(max(price, 1e-10) + 1.0), ratio, 1.0 if has_list else 0.0]
    if len(base.prices) < MIN_OBSERVATIONS:
        return head + [0.0] * 8
    mean, std = base.mean_std()
    low, high = base.ordered()[0], base.ordered()[-1]
    return head + [
        mean, std, low, high,
        (price - mean) / std if std > 0 else 0.0,
        base.change(price) or 0.0,
        price / mean if mean > 0 else 1.0,
        (price - low) / (high - low) if high > low else 0.5,
    ]


def _rank(severity: str | None) -> int:
    return {None: 0, "low": 1, "medium": 2, "high": 3, "critical": 4}[severity]


def _merge(results: list[tuple]) -> tuple:
    types = sorted({t for r in results for t in r[3].split(",") if t})
    severity = max((r[2] for r in results), key=_rank, default=None)
    return bool(types), max((r[1] for r in results), default=0.0), severity, ",".join(types), False


def cascade_rule(layers: list[dict], short_circuit: bool = True):
    """Layers run in order; a flagged gate layer stops the rest.

    Each layer: {"rules": {name: rule}, "gate": bool, "min": n, "max": n | None}.
    """
    def rule(price, base, row):
        n, done = len(base.prices), []
        for layer in layers:
            top = layer.get("max")
            if n < layer.get("min", 0) or (top is not None and n > top):
                continue
            results = [r(price, base, row) for r in layer["rules"].values()]
            done += results
            if layer.get("gate") and short_circuit and any(r[0] for r in results):
                break
        return _merge(done)
    return rule


def weighted_rule(members: list[tuple[Callable, float]], decide_at: float = 0.5):
    """Weighted mean of scores over members with enough history and a positive weight."""
    def rule(price, base, row):
        live = []
        for member, weight in members:
            result = member(price, base, row)
            if weight > 0 and not result[4]:
                live.append((result, weight))
        if not live:
            return NONE
        score = sum(r[1] * w for r, w in live) / sum(w for _, w in live)
        if score < decide_at:
            return False, score, None, "", False
        types = sorted({t for r, _ in live for t in r[3].split(",") if t})
        return True, score, _score_band(score), ",".join(types), False
    return rule
