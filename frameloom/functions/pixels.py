"""Per-pixel arithmetic as column expressions, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BT.709 luma weights; per-channel means and deviations that depth models are trained with.
BT709 = (0.2126, 0.7152, 0.0722)
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * BT709[0] + g * BT709[1] + b * BT709[2]


def channel_normalise(v: Column, channel: int) -> Column:
    """A channel's value as a depth model wants it."""
    return (v - IMAGE_MEAN[channel]) / IMAGE_STD[channel]


def first_channels(pixel: Column, n: int = 3) -> Column:
    """The first channels of an array of channels."""
    return F.slice(pixel, 1, n)


def preview(depth: Column) -> Column:
    """Depth as a grey pixel."""
    return F.array_repeat(clamp01(depth), 3)


def to_8bit(v: Column) -> Column:
    """Half up, not half to even."""
    return F.floor(clamp01(v) * 255 + 0.5).cast("int")


def to_16bit(v: Column) -> Column:
    return F.floor(clamp01(v) * 65535 + 0.5).cast("int")


def invert(depth: Column) -> Column:
    return 1 - depth


def gamma(depth: Column, power: float) -> Column:
    return clamp01(depth) if power == 1 else F.pow(clamp01(depth), F.lit(float(power)))


def disparity(depth: Column, zero_parallax: float, max_eye_px: float) -> Column:
    """Pixels between the eyes; each eye is shifted by half of it, in opposite directions."""
    return (depth - zero_parallax) * max_eye_px


def range_scale(v: Column, scale: float, pivot: float) -> Column:
    return v if abs(scale - 1) <= 1e-12 else pivot + (v - pivot) * scale


def compress_ends(v: Column, pivot: float, near: float = 0.0, far: float = 0.0) -> Column:
    """Values above the pivot are drawn towards it by ``near``, below by ``far``, the more the farther
    they are; the pivot stays. Strengths are held to 0..0.95."""
    near, far = (min(0.95, max(0.0, s)) for s in (near, far))

    def drawn(away: Column, room: float, strength: float) -> Column:
        return away * (1 - strength * clamp01(away / max(room, 1e-6)))

    out = v
    if near > 0 and pivot < 1:
        out = F.when(out > pivot, pivot + drawn(out - pivot, 1 - pivot, near)).otherwise(out)
    if far > 0 and pivot > 0:
        out = F.when(out < pivot, pivot - drawn(pivot - out, pivot, far)).otherwise(out)
    return out


def tune(depth: Column, *, zero_parallax: float = 0.0, scale: float = 1.0, near: float = 0.0, far: float = 0.0) -> Column:
    """Range scale, then compression, then clamp. Parameters that change nothing leave the value unclamped."""
    pivot = min(1.0, max(0.0, zero_parallax))
    if abs(scale - 1) <= 1e-12 and near <= 0 and far <= 0:
        return depth
    return clamp01(compress_ends(range_scale(depth, scale, pivot), pivot, near, far))


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a + w * (b - a)


def quantised(v: Column, scale: float = 1e6) -> Column:
    """A long that two engines agree on where doubles differ in the last place."""
    return F.floor(v * scale + 0.5).cast("long")
