"""Filling gaps, and noise on constant stretches.

Filling is sequential (a filled value feeds the windows after it), so a series is
one task; many series are many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.errors import check_choice, check_window
from seriesloom.functions.sliding import over
from seriesloom.session import ship

METHODS = {"mean": np.mean, "median": np.median, "min": np.min, "max": np.max}
FORWARD, BACKWARD = ("forward", "fwd", "f"), ("backward", "bwd", "b")
NOISE = 0.0000009
DEFAULTS = {"window": 4, "impute_method": "mean", "impute_direction": "forward", "add_noise": True}


def options(given: dict | None) -> dict | None:
    """Checked preprocessing options over their defaults; None for none."""
    if not given:
        return None
    if not isinstance(given, dict) or set(given) - set(DEFAULTS):
        raise ValueError(f"preprocessing options are {sorted(DEFAULTS)}, not {given!r}")
    got = {**DEFAULTS, **given}
    check_window(got["window"], 1)
    check_choice(got["impute_method"], METHODS, "impute_method")
    check_choice(got["impute_direction"], FORWARD + BACKWARD, "impute_direction")
    if not isinstance(got["add_noise"], bool):
        raise ValueError("add_noise must be true or false")
    return got


def fill(values: np.ndarray, window: int, method: str, forward: bool) -> np.ndarray:
    """One series: the ends take the first and last known value, then every window with a gap is filled from its known values.

    Goes from gap to gap: the next window to be filled is the first one, in the direction of
    travel, that reaches the next gap and holds a known value too.
    """
    x = np.array(values, float)
    at = np.flatnonzero(np.isfinite(x))
    if not len(at):
        return x
    x[0], x[-1] = x[at[0]], x[at[-1]]
    n, stat = len(x), METHODS[method]
    last = n - window  # the last start; travelling back, the first start is one beyond it and that window is short
    spot, stop = (0, last) if forward else (last + 1, 1)
    step = 1 if forward else -1
    while (stop - spot) * step >= 0:
        missing = np.flatnonzero(~np.isfinite(x))
        # starts whose window has a gap but is not all gap
        reach = missing[(missing >= spot) if forward else (missing < spot + window)]
        if not len(reach):
            break
        near = max(spot, int(reach[0]) - window + 1) if forward else min(spot, int(reach[-1]))
        spot = near
        part = x[spot : spot + window]
        gap = ~np.isfinite(part)
        if (stop - spot) * step >= 0 and gap.any() and not gap.all():
            part[gap] = stat(part[~gap])
        spot += step
    return x


def impute(series: DataFrame, window: int = 4, method: str = "mean", direction: str = "forward") -> DataFrame:
    """The series without gaps; a gap as long as a window stays where no value is near enough, as does a series without any."""
    check_window(window, 1)
    check_choice(method, METHODS, "method")
    check_choice(direction, FORWARD + BACKWARD, "direction")
    ship(series.sparkSession)
    forward = direction in FORWARD

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        frame["value"] = fill(frame["value"].to_numpy(dtype=float), window, method, forward)
        return frame

    return series.select("series_id", "idx", "value").groupBy("series_id").applyInPandas(run, "series_id string, idx bigint, value double")


def add_noise(series: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """A little uniform noise on every point that lies in a constant window; the same for the same seed."""
    v = F.col("value")
    flat = over(series, window, {"flat": lambda f: F.min(v).over(f) == F.max(v).over(f)}).select("series_id", "idx", F.col("flat").cast("int").alias("flat"))
    frame = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-(window - 1), 0)
    covered = series.join(flat, ["series_id", "idx"], "left").withColumn("in_flat", F.max(F.coalesce("flat", F.lit(0))).over(frame) == 1)
    u = F.pmod(F.xxhash64("series_id", "idx", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return covered.select("series_id", "idx", F.when(F.col("in_flat"), v + u * NOISE).otherwise(v).alias("value"))


def preprocess(series: DataFrame, window: int = 4, impute_method: str = "mean", impute_direction: str = "forward", add_noise_: bool = True, seed: int = 0) -> DataFrame:
    out = impute(series, window, impute_method, impute_direction)
    return add_noise(out, window, seed) if add_noise_ else out
