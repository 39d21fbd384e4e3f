"""Settings of an analysis, duration sets and quantile levels."""

from __future__ import annotations

from dataclasses import dataclass, field

# Rolling-window lengths in hours.
SUBDAILY = (1, 2, 3, 4, 6, 8, 10, 12, 18, 24)
DAILY = (24, 48, 72, 96, 120, 144, 192, 240, 288, 360)
ALL_DURATIONS = tuple(dict.fromkeys(SUBDAILY + DAILY))


def quantile_levels(widths) -> list[float]:
    """Two-sided levels of interval widths, with the median, sorted: 0.9 gives 0.05 and 0.95."""
    return sorted({0.5} | {round(x, 6) for w in widths for x in ((1 - w) / 2, 1 - (1 - w) / 2)})


def label(level: float) -> str:
    return f"{level:.3f}"


def window_rows(duration: float, step: float = 1.0) -> int:
    return int(duration / step)


def least_valid(rows: int) -> int:
    """Valid values that a window needs: nine tenths of its rows, one at least."""
    return max(int(0.9 * rows), 1)


@dataclass(frozen=True)
class FitConfig:
    start: int = 1979
    end: int = 2018
    durations: tuple[int, ...] = ALL_DURATIONS
    step_hours: float = 1.0
    n_sample: int = 1000
    widths: tuple[float, ...] = field(default=(0.9, 0.95, 0.99))
    shape: float | None = -0.114
    seed: int = 1
