"""Errors and argument checks that operators share."""

from __future__ import annotations


class NoSolutionPossible(Exception):
    """No window length satisfies the threshold."""


def check_window(w, least: int = 4, name: str = "window") -> int:
    if isinstance(w, bool) or not isinstance(w, int) or w < least:
        raise ValueError(f"{name} must be an integer of at least {least}, not {w!r}")
    return w


def check_fraction(x, name: str, low_open: bool = False, high_open: bool = False) -> float:
    if isinstance(x, bool) or not isinstance(x, float) or not 0 <= x <= 1 or (low_open and x == 0) or (high_open and x == 1):
        raise ValueError(f"{name} must be a float between 0 and 1, not {x!r}")
    return x


def check_choice(x, choices, name: str):
    if x not in choices:
        raise ValueError(f"{name} must be one of {sorted(map(str, choices))}, not {x!r}")
    return x
