"""Tables that a plotting tool can draw as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import sliding

LEVELS = 256


def series_and_profile(series: DataFrame, profile: DataFrame) -> DataFrame:
    """Every point with the profile value of the window that starts there; null in the tail."""
    keep = [c for c in profile.columns if c not in ("series_id", "idx")]
    return series.select("series_id", "idx", "value").join(profile.select("series_id", "idx", *keep), ["series_id", "idx"], "left")


def heat(pan: DataFrame) -> DataFrame:
    """Pan profile in ``LEVELS`` steps, distances over the largest of their length, at most 1."""
    top = F.sqrt(4.0 * F.col("w"))
    return pan.select("series_id", "w", "idx", F.least(F.lit(1.0), F.ceil(F.col("mp") / top * LEVELS) / LEVELS).alias("level"))


def stretches(series: DataFrame, picks: DataFrame, kind: str) -> DataFrame:
    """The points of every picked window, numbered from its start."""
    offset = F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("offset")
    wide = picks.select("*", offset).withColumn("at", F.col("idx") + F.col("offset"))
    points = series.select("series_id", F.col("idx").alias("at"), "value")
    return wide.join(points, ["series_id", "at"]).withColumn("kind", F.lit(kind)).drop("at")


def intervals(snippets: DataFrame) -> DataFrame:
    """(series_id, rank, start, stop): runs of consecutive places that a snippet stands for."""
    at = snippets.select("series_id", "rank", F.explode("neighbors").alias("idx"))
    island = F.col("idx") - F.row_number().over(Window.partitionBy("series_id", "rank").orderBy("idx"))
    return at.withColumn("i", island).groupBy("series_id", "rank", "i").agg(F.min("idx").alias("start"), F.max("idx").alias("stop")).drop("i")


def statistics(series: DataFrame, w: int) -> DataFrame:
    """Every point with the moving statistics of the window that starts there, and the series' own."""
    whole, moving = sliding.statistics(series, w)
    return series_and_profile(series, moving).join(whole.drop("n"), "series_id")


def corrected(profile: DataFrame) -> DataFrame:
    """One line per quantity of a corrected profile: (series_id, w, idx, line, y)."""
    lines = [c for c in ("mp", "av", "cmp") if c in profile.columns]
    return profile.select("series_id", "w", "idx", F.explode(F.create_map(*[x for c in lines for x in (F.lit(c), F.col(c))])).alias("line", "y"))


def snippet_lines(snippets: DataFrame) -> DataFrame:
    """(series_id, rank, offset, value): the points of every snippet."""
    return snippets.select("series_id", "rank", F.posexplode("snippet").alias("offset", "value"))


def is_visualizable(made) -> bool:
    """Whether ``plot`` has tables for a result."""
    return getattr(made, "kind", None) in ("profile", "pan", "statistics")


def combine(*tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of several plots; those of one name are stacked, columns by name."""
    out: dict[str, DataFrame] = {}
    for group in tables:
        for name, df in group.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out


def plot(made) -> dict[str, DataFrame]:
    """The tables for a router's result, and for whatever was added to its ``tables``."""
    if not is_visualizable(made):
        raise ValueError("nothing to plot in this")
    out, have = {}, made.tables
    if made.kind == "pan":
        out["heat"] = heat(made.profile)
    elif made.kind == "statistics":
        out["statistics"] = statistics(made.series, made.windows[0])
    else:
        out["lines"] = series_and_profile(made.series, made.profile)
    if "cmp" in have:
        out["corrected"] = corrected(have["cmp"])
    if "discords" in have:
        out["discord_windows"] = stretches(made.series, have["discords"], "discord")
    if "motifs" in have:
        out["motif_windows"] = stretches(made.series, have["motifs"], "motif")
    if "snippets" in have:
        out["snippet_lines"], out["snippet_intervals"] = snippet_lines(have["snippets"]), intervals(have["snippets"])
    if "regimes" in have:
        out["regime_marks"] = have["regimes"].select("series_id", "rank", "idx")
    return out
