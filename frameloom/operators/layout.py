"""Between dense frames and pixel rows; eyes and side-by-side pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_pixels(frames: DataFrame, keys: Sequence[str], values: str, width: int, *, out: str = "v") -> DataFrame:
    """Pixel rows of a row-major array column."""
    cells = frames.select(*keys, F.posexplode(values).alias("_at", out))
    at = F.col("_at").cast("long")
    return cells.select(*keys, F.floor(at / width).cast("long").alias("y"), (at % width).alias("x"), out)


def to_frames(pixels: DataFrame, keys: Sequence[str], value: str, *, out: str = "values") -> DataFrame:
    """Row-major arrays again. A row of pixels is put together first, so a task holds rows, then frames of rows."""
    rows = pixels.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", value))).alias("_row"))
    rows = rows.select(*keys, "y", F.transform("_row", lambda p: p[value]).alias("_row"))
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "_row"))).alias("_rows"))
    return whole.select(*keys, F.flatten(F.transform("_rows", lambda r: r["_row"])).alias(out))


def split_eyes(pixels: DataFrame, width: int) -> DataFrame:
    """The two halves of a side-by-side picture as streams of their own: eye 0 is left, 1 right."""
    if width % 2:
        raise ValueError(f"a side-by-side picture of odd width {width}")
    half = width // 2
    return pixels.withColumn("eye", F.floor(F.col("x") / half).cast("int")).withColumn("x", F.col("x") % half)


def side_by_side(left: DataFrame, right: DataFrame, eye_width: int, *, swap: bool = False) -> DataFrame:
    """One picture from two eyes: a union, no shuffle."""
    if left.columns != right.columns:
        raise ValueError("eyes differ in their columns")
    first, second = (right, left) if swap else (left, right)
    return first.unionByName(second.withColumn("x", F.col("x") + eye_width))


def side_by_side_frames(frames: DataFrame, left: str, right: str, eye_width: int, *, out: str = "sbs", swap: bool = False) -> DataFrame:
    """The same on dense frames, row by row of the picture."""
    a, b = (right, left) if swap else (left, right)
    height = F.floor(F.size(a) / eye_width).cast("int")
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.concat(F.slice(a, y * eye_width + 1, eye_width), F.slice(b, y * eye_width + 1, eye_width)))
    return frames.withColumn(out, F.flatten(rows))


def crop(pixels: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """A part of the picture, moved to the origin: a filter that reaches the scan."""
    inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    return pixels.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def reflect_pad(pixels: DataFrame, height: int, width: int, multiple: int) -> DataFrame:
    """Padded at the lower and right edge to multiples, mirrored without repeating the edge."""
    full_h, full_w = (-(-n // multiple) * multiple for n in (height, width))

    def places(name: str, n: int, full: int):
        own = F.col(name)
        mirrored = 2 * (n - 1) - own
        return F.explode(F.when((mirrored >= n) & (mirrored < full) & (mirrored != own), F.array(own, mirrored)).otherwise(F.array(own)))

    if full_h - height >= height or full_w - width >= width:
        raise ValueError("padding exceeds the picture")
    return pixels.withColumn("y", places("y", height, full_h)).withColumn("x", places("x", width, full_w))


def decode_chain(pixels: DataFrame, keys: Sequence[str], idx: str, columns: Sequence[str], size: tuple[int, int], *, rate: float = 0, force_rate: float = 0, to: tuple[int, int] = (0, 0), cap: int = 0) -> tuple[DataFrame, tuple[int, int]]:
    """Frames at another rate and size, and that size: the frame whose time is nearest before each new one's, the
    middle of the picture at the target's shape, a bicubic resize. A side of 0 follows from the other one.

    ``idx`` counts from 0. The rate is a map from frames to the new ones they stand for, so nothing is shuffled for it."""
    from .spatial import resize

    if force_rate and rate and force_rate != rate:
        first, after = (F.ceil(F.col(idx) * force_rate / rate), F.ceil((F.col(idx) + 1) * force_rate / rate))
        pixels = pixels.where(after > first).withColumn(idx, F.explode(F.sequence(first.cast("long"), (after - 1).cast("long"))))
    if cap:
        pixels = pixels.where(F.col(idx) < cap)
    (h, w), (th, tw) = size, to
    th, tw = (th or (round(tw * h / w) if tw else h)), (tw or (round(th * w / h) if th else w))
    if (th, tw) == (h, w):
        return pixels, size
    own = (h, min(w, max(1, round(h * tw / th)))) if h * tw <= w * th else (min(h, max(1, round(w * th / tw))), w)
    if own != (h, w):
        pixels = crop(pixels, (h - own[0]) // 2, (w - own[1]) // 2, *own)
    return resize(pixels, [*keys, idx], columns, own, (th, tw), kernel="cubic"), (th, tw)
