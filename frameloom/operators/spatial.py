"""Neighbourhoods, filters and resizing over pixel rows.

Windows along x come first and share the partitioning by (frame, y); windows along y need one exchange.
Rows of a window partition are one row or column of one picture, so no task grows with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import clamp01, lerp, luma


#: Rows of a resize's table of taps, which is broadcast; a picture that needs more is refused.
MOST_TAPS = 1 << 20


def _along(keys: Sequence[str], fixed: str, moving: str, r: int):
    return Window.partitionBy(*keys, fixed).orderBy(moving).rowsBetween(-r, r)


def _separable(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], r: int, of: Callable[[Column | str], Column]) -> DataFrame:
    for fixed, moving in (("y", "x"), ("x", "y")):
        w = _along(keys, fixed, moving, r)
        pixels = pixels.withColumns({c: of(F.col(c)).over(w) for c in columns})
    return pixels


def box_mean(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], radius: int) -> DataFrame:
    """Means over (2 radius + 1) squared neighbours, fewer at edges, of several columns at once."""
    return pixels if radius <= 0 else _separable(pixels, keys, columns, radius, F.avg)


def dilate(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], radius: int) -> DataFrame:
    return pixels if radius <= 0 else _separable(pixels, keys, columns, radius, F.max)


def gradient(pixels: DataFrame, keys: Sequence[str], column: str, *, out: str) -> DataFrame:
    """The greater of the differences to the left and the upper neighbour; an edge has none there."""
    left = F.lag(column).over(Window.partitionBy(*keys, "y").orderBy("x"))
    up = F.lag(column).over(Window.partitionBy(*keys, "x").orderBy("y"))
    v = F.col(column)
    return pixels.withColumn(out, F.greatest(F.coalesce(F.abs(v - left), F.lit(0.0)), F.coalesce(F.abs(v - up), F.lit(0.0))))


def guided_filter(pixels: DataFrame, keys: Sequence[str], guide: str, depth: str, *, strength: float = 0.14, radius: int = 4, edge_protection: float = 0.8, out: str = "smoothed") -> DataFrame:
    """Depth smoothed along the guide's edges. Two box means: of four moments, then of both coefficients."""
    if strength <= 0 or radius <= 0:
        return pixels.withColumn(out, F.col(depth))
    strength, protect = min(1.0, strength), min(1.0, max(0.0, edge_protection))
    eps = 1e-6 + (1 - protect) ** 2 * 2.5e-2
    i, p = F.col(guide), F.col(depth)
    moments = box_mean(pixels.withColumns({"_i": i, "_p": p, "_ii": i * i, "_ip": i * p}), keys, ["_i", "_p", "_ii", "_ip"], radius)
    variance = F.greatest(F.lit(0.0), F.col("_ii") - F.col("_i") * F.col("_i"))
    slope = (F.col("_ip") - F.col("_i") * F.col("_p")) / (variance + eps)
    fitted = moments.withColumn("_a", slope).withColumn("_b", F.col("_p") - F.col("_a") * F.col("_i"))
    smooth = box_mean(fitted, keys, ["_a", "_b"], radius)
    q = F.col("_a") * i + F.col("_b")
    return smooth.withColumn(out, clamp01(lerp(p, q, F.lit(strength)))).drop("_i", "_p", "_ii", "_ip", "_a", "_b")


def feather(pixels: DataFrame, keys: Sequence[str], depth: str, *, strength: float = 0.15, radius: int = 1, threshold: float = 0.04, guide: str | None = None, guidance: float = 0.5, out: str = "feathered") -> DataFrame:
    """Depth drawn to its box mean beside depth edges; with a luma guide, the more where that has edges too."""
    strength = min(1.0, max(0.0, strength))
    if strength <= 0 or radius <= 0:
        return pixels.withColumn(out, F.col(depth))
    thr = max(1e-6, threshold)
    edges = gradient(pixels, keys, depth, out="_edge").withColumn("_mask", clamp01((F.col("_edge") - thr) / thr))
    mask = dilate(edges, keys, ["_mask"], radius)
    if guide:
        g = min(1.0, max(0.0, guidance))
        mask = gradient(mask, keys, guide, out="_gedge").withColumn("_mask", F.col("_mask") * ((1 - g) + g * clamp01(F.col("_gedge") / 0.08)))
    soft = box_mean(mask.withColumn("_soft", F.col(depth)), keys, ["_soft"], radius)
    return soft.withColumn(out, clamp01(lerp(F.col(depth), F.col("_soft"), F.col("_mask") * strength))).drop("_edge", "_mask", "_gedge", "_soft")


def area_average(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Averages over the cells of a coarser grid. Where sizes don't divide, cells overlap and a pixel counts in each."""

    def cells(name: str, n: int, m: int) -> Column:
        at = F.col(name)
        return F.explode(F.sequence(F.floor(at * m / n).cast("long"), F.least(F.lit(m - 1), F.ceil((at + 1) * m / n).cast("long") - 1)))

    (h, w), (th, tw) = size, to
    spread = pixels.withColumn("_cy", cells("y", h, th)).withColumn("_cx", cells("x", w, tw))
    return spread.groupBy(*keys, F.col("_cy").alias("y"), F.col("_cx").alias("x")).agg(*[F.avg(c).alias(c) for c in columns])


def strided(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """A centred sample of about the wanted size, and its size: a filter before any other work."""
    steps = [max(1, round(n / max(1, m))) for n, m in zip(size, to, strict=True)]
    begin = [s // 2 if s > 1 else 0 for s in steps]
    keep = [(F.col(c) >= b) & ((F.col(c) - b) % s == 0) for c, b, s in zip(("y", "x"), begin, steps, strict=True)]
    out = pixels.where(keep[0] & keep[1]).withColumns({c: F.floor((F.col(c) - b) / s).cast("long") for c, b, s in zip(("y", "x"), begin, steps, strict=True)})
    return out, tuple(len(range(b, n, s)) for b, n, s in zip(begin, size, steps, strict=True))


def _taps(n: int, m: int, kernel: str) -> pd.DataFrame:
    """Target, source and weight of each tap of a resize from n to m with half-pixel centres; edges repeat.

    linear: two taps; antialias: a triangle as wide as the step where it shrinks; cubic: four taps with a = -0.75.
    """
    rows = []
    step = n / m
    for t in range(m):
        centre = (t + 0.5) * step - 0.5
        if kernel == "antialias":
            wide = max(1.0, step)
            first, last = int(np.floor(centre - wide)) + 1, int(np.ceil(centre + wide))
            own = {s: max(0.0, 1 - abs(s - centre) / wide) for s in range(max(0, first), min(n, last))}
            total = sum(own.values())
            rows += [(t, s, w / total) for s, w in own.items() if w > 0]
            continue
        if kernel == "linear":
            centre = max(0.0, centre)
            s, f = int(np.floor(centre)), centre - np.floor(centre)
            taps = {s: 1 - f, s + 1: f}
        else:
            s, f, a = int(np.floor(centre)), centre - np.floor(centre), -0.75
            far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
            mid = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
            taps = {s - 1: far(1 + f), s: mid(f), s + 1: mid(1 - f), s + 2: far(2 - f)}
        for s, w in taps.items():
            if w:
                rows.append((t, min(n - 1, max(0, s)), w))
    return pd.DataFrame(rows, columns=["to", "from", "weight"]).groupby(["to", "from"], as_index=False).sum()


def resize(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], size: tuple[int, int], to: tuple[int, int], *, kernel: str = "linear") -> DataFrame:
    """Separable resize: per axis an equi-join with the taps, then weighted sums.

    The taps are a few rows per row or column of the target picture (4 at most, but for strong
    shrinking), so their broadcast is bounded by the picture's size, which is checked.
    """
    if kernel not in ("linear", "antialias", "cubic"):
        raise ValueError(f"kernel {kernel}")
    spark = pixels.sparkSession
    for axis, other, n, m in (("x", "y", size[1], to[1]), ("y", "x", size[0], to[0])):
        if n == m:
            continue
        taps = _taps(n, m, kernel)
        if len(taps) > MOST_TAPS:
            raise ValueError("a picture of that size is resized on dense frames")
        joined = pixels.join(F.broadcast(spark.createDataFrame(taps, "_to long, _from long, _w double")), F.col(axis) == F.col("_from"))
        pixels = joined.groupBy(*keys, other, F.col("_to").alias(axis)).agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns])
    return pixels.select(*keys, "y", "x", *columns)


def nearest_resize(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], keys: Sequence[str]) -> DataFrame:
    """Each target pixel takes the source at floor(target * size / to)."""
    spark = pixels.sparkSession
    if max(to) > MOST_TAPS:
        raise ValueError(f"a picture of {to[0]} x {to[1]}")
    for axis, n, m in (("y", size[0], to[0]), ("x", size[1], to[1])):
        places = spark.range(m).select(F.col("id").alias(f"_{axis}"), F.floor(F.col("id") * n / m).cast("long").alias(f"_from_{axis}"))
        pixels = pixels.join(F.broadcast(places), F.col(axis) == F.col(f"_from_{axis}")).withColumn(axis, F.col(f"_{axis}")).drop(f"_{axis}", f"_from_{axis}")
    return pixels


def resize_mask(pixels: DataFrame, keys: Sequence[str], mask: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    out = nearest_resize(pixels, size, to, keys)
    return out.withColumn(mask, F.col(mask).cast("double") > 0.5)


def depth_guide(pixels: DataFrame, keys: Sequence[str], size: tuple[int, int], to: tuple[int, int], rgb: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Luma at the depth map's size: a strided sample, a resize of what is left, then luma in 0..1."""
    sample, own = strided(pixels.select(*keys, "y", "x", *rgb), size, to)
    small = resize(sample, keys, rgb, own, to)
    return small.select(*keys, "y", "x", clamp01(luma(*[F.col(c) for c in rgb])).alias("guide"))


def resize_frames(frames: DataFrame, column: str, size: tuple[int, int], to: tuple[int, int], *, kernel: str = "linear", channels: int = 1) -> DataFrame:
    """The same resize on dense row-major frames, in Arrow batches: one small matrix per axis."""
    mats = []
    for n, m in zip(size, to, strict=True):
        mat = np.zeros((m, n))
        taps = _taps(n, m, kernel) if n != m else pd.DataFrame({"to": range(n), "from": range(n), "weight": 1.0})
        mat[taps["to"].to_numpy(), taps["from"].to_numpy()] = taps["weight"].to_numpy()
        mats.append(mat)
    schema = frames.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shaped = [np.asarray(v, float).reshape(*size, channels) for v in part[column]]
            part[column] = [np.einsum("ij,jkc,lk->ilc", mats[0], v, mats[1]).reshape(-1) for v in shaped]
            yield part

    return frames.mapInPandas(run, schema)
