"""Depth-image based rendering: forward splat with a z-buffer, hole filling, backward warp, both eyes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import clamp01, disparity, gamma
from .spatial import resize, resize_mask

RENDERERS = ("zbuffer", "zbuffer_async", "zbuffer_profile", "zbuffer_pair", "zbuffer_batched", "zbuffer_fused", "grid_sample")
#: How near to the front a tap must be to count, the least weight that isn't a hole, how alike depths are.
Z_NEAR, LEAST_WEIGHT, ALIKE = 1e-5, 1e-8, 0.02


def splat(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], depth: str, shift: Column, width: int) -> DataFrame:
    """Every pixel moves by ``shift`` along x and falls on two neighbours by its fraction; at each target the
    nearest depth wins and the taps within Z_NEAR of it are averaged by weight.

    Returns the whole grid: colours (null in holes), depth (1 in holes) and hole. Targets of a row
    come from the same row, so one partitioning by (keys, y) serves the z-buffer, the sums and the grid.
    """
    target = F.col("x") + shift
    left = F.floor(target).cast("long")
    moved = pixels.withColumn("_t", target).withColumn("_x0", left).withColumn("_f", F.col("_t") - F.col("_x0"))
    tap = F.explode(F.array(F.struct(F.col("_x0").alias("x"), (1 - F.col("_f")).alias("w")), F.struct((F.col("_x0") + 1).alias("x"), F.col("_f").alias("w"))))
    taps = moved.select(*keys, "y", *colours, F.col(depth).alias("_z"), tap.alias("_tap")).select(*keys, "y", F.col("_tap.x").alias("x"), *colours, "_z", F.col("_tap.w").alias("_w"))
    taps = taps.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("_w") > 0))
    cell = [*keys, "y", "x"]
    front = F.max("_z").over(Window.partitionBy(*cell))
    winners = taps.withColumn("_front", front).where(F.col("_z") >= F.col("_front") - Z_NEAR)
    hit = winners.groupBy(*cell).agg(F.max("_front").alias("_front"), F.sum("_w").alias("_w"), *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in colours])
    grid = pixels.select(*cell)
    seen = F.col("_w") > LEAST_WEIGHT
    return grid.join(hit, cell, "left").select(*cell, *[F.when(seen, F.col(c) / F.col("_w")).alias(c) for c in colours], F.coalesce("_front", F.lit(1.0)).alias(depth), (~F.coalesce(seen, F.lit(False))).alias("hole"))


def fill_holes(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], depth: str, *, max_distance: int = 160) -> DataFrame:
    """Holes take the nearest seen pixel to their left or right: the farther one (less depth), the nearer in x
    if their depths are alike, the only one within the distance, else the nearest however far; 0 where a
    row has none. An as-of join in both directions, as two windows over a row of the picture."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    seen = F.when(~F.col("hole"), F.struct("x", F.col(depth).alias("z"), *colours))
    both = pixels.withColumns(
        {
            "_l": F.last(seen, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)),
            "_r": F.first(seen, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    far = F.lit(10**9).cast("long")
    dl, dr = F.coalesce(F.col("x") - F.col("_l.x"), far), F.coalesce(F.col("_r.x") - F.col("x"), far)
    ok_l, ok_r = dl <= max_distance, dr <= max_distance
    background = F.when(F.abs(F.col("_l.z") - F.col("_r.z")) < ALIKE, dl <= dr).otherwise(F.col("_l.z") < F.col("_r.z"))
    left = F.when(ok_l & ok_r, background).when(ok_l, F.lit(True)).when(ok_r, F.lit(False)).otherwise(dl <= dr)
    chosen = both.withColumn("_c", F.when(left, F.col("_l")).otherwise(F.col("_r")))
    filled = {c: F.when(F.col("hole"), F.coalesce(F.col(f"_c.{c}"), F.lit(0.0))).otherwise(F.col(c)) for c in colours}
    return chosen.withColumns(filled).drop("_l", "_r", "_c")


def backward_warp(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], shift: Column, width: int) -> DataFrame:
    """Each pixel samples at x - shift, between two neighbours, the border beyond the edge; no holes."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(width - 1)), F.col("x") - shift))
    asked = pixels.select(*keys, "y", "x", at.alias("_at")).withColumn("_x0", F.floor("_at").cast("long")).withColumn("_f", F.col("_at") - F.col("_x0"))
    tap = F.explode(F.array(F.struct(F.col("_x0").alias("s"), (1 - F.col("_f")).alias("w")), F.struct(F.least(F.lit(width - 1).cast("long"), F.col("_x0") + 1).alias("s"), F.col("_f").alias("w"))))
    taps = asked.select(*keys, "y", "x", tap.alias("_tap")).select(*keys, "y", "x", F.col("_tap.s").alias("_s"), F.col("_tap.w").alias("_w"))
    source = pixels.select(*keys, "y", F.col("x").alias("_s"), *colours)
    return taps.join(source, [*keys, "y", "_s"]).groupBy(*keys, "y", "x").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in colours]).withColumn("hole", F.lit(False))


def render_eye(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], depth: str, direction: int, size: tuple[int, int], *, max_eye_px: float, zero_parallax: float = 0.0, depth_gamma: float = 1.0, renderer: str = "zbuffer", hole_fill: bool = True, max_fill_distance: int = 160, half: bool = False) -> DataFrame:
    """One eye (+1 left, -1 right): colours and hole, the holes being those before filling. A renderer of an
    unknown name is the z-buffer, and all the z-buffer's variants give the same picture."""
    shaped = pixels.withColumn("_z", gamma(F.col(depth), depth_gamma))
    eye_width = size[1] // 2 if half else size[1]
    shift = direction * disparity(F.col("_z"), zero_parallax, max_eye_px * (size[1] / eye_width)) * 0.5
    if renderer == "grid_sample":
        eye = backward_warp(shaped, keys, colours, shift, size[1])
    else:
        eye = splat(shaped, keys, colours, "_z", shift, size[1])
        eye = fill_holes(eye, keys, colours, "_z", max_distance=max_fill_distance) if hole_fill else eye.fillna(0.0, list(colours))
    if half:
        to = (size[0], eye_width)
        small = resize(eye, keys, colours, size, to, kernel="antialias")
        eye = small.join(resize_mask(eye.select(*keys, "y", "x", "hole"), keys, "hole", size, to), [*keys, "y", "x"])
    return eye.select(*keys, "y", "x", *[clamp01(F.col(c)).alias(c) for c in colours], "hole")


def render_stereo(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], depth: str, size: tuple[int, int], **how) -> tuple[DataFrame, DataFrame]:
    """Left and right eye."""
    return tuple(render_eye(pixels, keys, colours, depth, d, size, **how) for d in (1, -1))


def upsample_depth(depth: DataFrame, keys: Sequence[str], column: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """A depth map at the picture's size, in 0..1: a bilinear resize, which comes before gamma."""
    big = depth if tuple(size) == tuple(to) else resize(depth, keys, [column], size, to)
    return big.select(*keys, "y", "x", clamp01(F.col(column)).alias(column))


def render_with_depth(rgb: DataFrame, depth: DataFrame, keys: Sequence[str], colours: Sequence[str], column: str, size: tuple[int, int], depth_size: tuple[int, int], **how) -> tuple[DataFrame, DataFrame]:
    """Left and right eye of pictures whose depth maps have a size of their own."""
    both = join_depth(rgb, upsample_depth(depth, keys, column, depth_size, size), [*keys, "y", "x"])
    return render_stereo(both, keys, colours, column, size, **how)


def join_depth(rgb: DataFrame, depth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Colour and depth by place; a frame that only one side has stops the query."""
    both = rgb.join(depth, list(keys), "full_outer")
    missing = [c for c in rgb.columns if c not in keys][:1] + [c for c in depth.columns if c not in keys][:1]
    bad = F.col(missing[0]).isNull() | F.col(missing[1]).isNull()
    return both.where(F.when(bad, F.raise_error(F.lit("colour and depth differ in length")).cast("boolean")).otherwise(F.lit(True)))
