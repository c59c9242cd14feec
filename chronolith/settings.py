"""Settings given as text. These run on the driver; what they return goes into plans as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

ASSET_CAP_FILES = 20_000
ASSET_CAP_BYTES = 25 * 1048576
BUDGET_SHARE = 0.75
MARGIN_SHARE = 0.1
STALE_MINUTES = 5
TIMEOUT_MS = 60_000
LARGEST_TIMEOUT_MS = 2**31 - 1


def number(text: object) -> float:
    """The number that a setting's text stands for, NaN if none; blank text is 0."""
    if text is None:
        return math.nan
    if isinstance(text, (int, float)):
        return float(text)
    bare = str(text).strip()
    if not bare:
        return 0.0
    prefix = bare[:2].lower()
    try:
        if prefix in ("0x", "0o", "0b"):
            return float(int(bare, 0))
        return math.nan if "_" in bare or bare.lower().lstrip("+-") in ("nan", "inf") or ("infinity" in bare.lower() and "Infinity" not in bare) else float(bare)
    except ValueError:
        return math.nan


def positive_int(text: object) -> int:
    n = number(text)
    return int(n) if math.isfinite(n) and n > 0 and n == int(n) else 0


def stale_ms(text: object = None) -> float:
    """Minutes to milliseconds; missing, blank, 0 and non-numbers mean the default, negatives pass."""
    n = number(text) if text is not None else 0.0
    return (STALE_MINUTES if not n or math.isnan(n) else n) * 60_000


def timeout_ms(text: object = None, budget_left: float | None = None) -> int:
    """A whole number of milliseconds that a timer can hold, else the default; never above what is left."""
    n = number(text) if text is not None else math.nan
    chosen = int(n) if math.isfinite(n) and n == int(n) and 1 <= n <= LARGEST_TIMEOUT_MS else TIMEOUT_MS
    return chosen if budget_left is None else int(min(chosen, budget_left))


@dataclass(frozen=True)
class AssetLimits:
    cap: int
    budget: int
    margin: int


def asset_limits(cap: object = None, budget: object = None) -> AssetLimits:
    top = positive_int(cap) or ASSET_CAP_FILES
    kept = min(positive_int(budget) or math.floor(top * BUDGET_SHARE), top)
    return AssetLimits(top, kept, top - kept)
