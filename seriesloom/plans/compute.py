"""Routers: from what is asked to the operators that answer it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from seriesloom.errors import check_window
from seriesloom.operators import discover, impute, nearest, pan


@dataclass
class Result:
    """What a router made: ``profile`` and the tables derived from it."""

    kind: str  # profile, pan
    algorithm: str  # exact, sampled, pan
    windows: list[int]
    profile: DataFrame
    series: DataFrame
    sample_pct: float = 1.0
    tables: dict[str, DataFrame] = field(default_factory=dict)


def compute(series: DataFrame, windows=None, query: DataFrame | None = None, sample_pct: float = 1, threshold: float | None = 0.98, preprocessing: dict | None = None) -> Result:
    """One window length: exact join (``sample_pct`` 1) or a sampled one.  Several, or none: a pan profile.

    Without lengths, they run from 8 to the longest at which windows still
    correlate by ``threshold`` (one series).
    """
    lengths = [windows] if isinstance(windows, int) and not isinstance(windows, bool) else list(windows or [])
    if not lengths and not isinstance(threshold, float):
        raise ValueError("either window lengths or a float threshold are needed")
    for w in lengths:
        check_window(w)
    opts = impute.options(preprocessing)
    if opts:
        series = impute.preprocess(series, opts["window"], opts["impute_method"], opts["impute_direction"], opts["add_noise"])
    if not lengths:
        upper = pan.maximum_subsequence(series, threshold)
        lengths = list(range(8, upper + 1))
        return Result("pan", "pan", lengths, pan.pan_profile(series, lengths, sample_pct), series, sample_pct)
    if len(lengths) > 1:
        return Result("pan", "pan", lengths, pan.pan_profile(series, lengths, 1.0), series)
    w = lengths[0]
    if sample_pct >= 1:
        made = nearest.self_join(series, w) if query is None else nearest.ab_join(series, query, w)
        return Result("profile", "exact", lengths, made, series)
    return Result("profile", "sampled", lengths, nearest.sampled(series, w, float(sample_pct), query=query), series, float(sample_pct))


def analyze(series: DataFrame, windows=None, query: DataFrame | None = None, sample_pct: float = 1.0, threshold: float | None = 0.98, preprocessing: dict | None = None, k: int = 3) -> Result:
    """``compute``, and motifs, discords and plot tables of what it made."""
    from seriesloom.plans import frames

    if not 0 < sample_pct <= 1:
        raise RuntimeError("sample_pct must be above 0 and at most 1")
    made = compute(series, windows, query, sample_pct, threshold, preprocessing)
    if query is None:
        made.tables["motifs"] = discover.motifs(made.series, made.profile, k)
    pick = discover.pan_discords if made.kind == "pan" else discover.discords
    made.tables["discords"] = pick(made.profile, k)
    made.tables |= frames.plot(made)
    return made
