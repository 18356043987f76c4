"""Declarative feature lines and the horizon grid (driver-side Python, never touches data)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from enum import Enum


class Fn(Enum):
    """Aggregate functions a feature line can name; the value is the name used in the output column."""

    SUM = "sum"
    AVG = "mean"
    MIN = "min"
    MAX = "max"
    ISNULL = "isnull"  # modifier: look at non-null rows only
    DIFF_DATE_MIN = "diff_date_min"
    DIFF_DATE_MAX = "diff_date_max"


DATE_DIFFS = (Fn.DIFF_DATE_MIN, Fn.DIFF_DATE_MAX)


@dataclass(frozen=True)
class Line:
    """One metric, its functions, the window lengths, and whether windows are cumulative or single periods."""

    metric: str
    functions: tuple[Fn, ...]
    lengths: tuple[int, ...]
    mode: str = "agg"

    @property
    def nulls_as_missing(self) -> bool:
        return Fn.ISNULL in self.functions


@dataclass(frozen=True)
class Horizon:
    """Label window: churn period ``cp`` periods long that starts ``ph`` periods after the break."""

    ph: int
    cp: int

    @property
    def last_slot(self) -> int:
        return 4 - self.ph

    @property
    def first_slot(self) -> int:
        return 4 - self.ph + self.cp - 1


def line(metric: str, functions: Fn | Iterable[Fn], lengths: Sequence[int], mode: str = "agg") -> Line:
    """Build a :class:`Line`; ``functions`` may be one function or several."""
    fns = (functions,) if isinstance(functions, Fn) else tuple(functions)
    if mode not in ("agg", "only"):
        raise ValueError(f"mode must be 'agg' or 'only', got {mode!r}")
    return Line(metric.upper(), fns, tuple(lengths), mode)


def expand(lines: Iterable[Line]) -> dict[tuple[int, str], list[Line]]:
    """Group feature lines by (window length, mode), keeping first-seen order."""
    grouped: dict[tuple[int, str], list[Line]] = {}
    for item in lines:
        for length in item.lengths:
            grouped.setdefault((length, item.mode), []).append(item)
    return grouped


def column_name(metric: str, fn: Fn, length: int, mode: str, unit: str = "S", prefix: str = "FF_") -> str:
    """Generated feature name, for example ``FF_RN_SUM_L13S`` or ``FF_MARKUP_MEAN_L2SO``."""
    suffix = "O" if mode == "only" else ""
    return f"{prefix}{metric}_{fn.value}_L{length}{unit}{suffix}".upper()


def horizons() -> list[Horizon]:
    """The sixteen prediction-horizon and churn-period pairs, longest first."""
    return [Horizon(ph, cp) for ph in (4, 3, 2, 1) for cp in (4, 3, 2, 1)]


def clamp_horizon(ph: int, cp: int) -> Horizon:
    """Out-of-range parameters fall back to 1."""
    return Horizon(ph if 1 <= ph <= 4 else 1, cp if 1 <= cp <= 4 else 1)


def feature_columns(columns: Iterable[str]) -> list[str]:
    """Columns that play the feature role, decided by the ``FF_`` prefix."""
    return [name for name in columns if name.startswith("FF_")]


def unique(names: Iterable[str]) -> list[str]:
    """Ordered de-duplication of a name list."""
    return list(dict.fromkeys(names))
