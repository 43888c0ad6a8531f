"""Ordered operators: pairs, cuts, normalisation, densification, windows, alignment.

Neighbours in a stream with contiguous indices meet by an equi-join on the index, so that one long
stream is spread over the cluster. Only true recursions (an average that resets on its own result,
the alignment chain) go through a stream in order, one row at a time, with one row of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import luma
from .layout import to_frames
from .spatial import area_average

#: Fixed values of the depth windows: their length and step, the overlap that is blended and what lies before it.
WINDOW, STEP, OVERLAP, BLEND = 32, 22, 10, 8
KEYFRAMES = (0, 12, 24, 25, 26, 27, 28, 29, 30, 31)
_HEAD = OVERLAP - BLEND


def next_by_index(df: DataFrame, keys: Sequence[str], idx: str, columns: dict[str, str]) -> DataFrame:
    """Each row with columns of the row one index later, null at the end: an equi-join."""
    after = df.select(*keys, (F.col(idx) - 1).alias(idx), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(after, [*keys, idx], "left")


def next_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The same for series without an index, by a window over each stream."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({n: F.lead(c).over(w) for c, n in columns.items()})


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Of two arrays of one length; null for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def cut_after(df: DataFrame, keys: Sequence[str], idx: str, proxy: str, threshold: float, *, out: str = "cut") -> DataFrame:
    """Whether a cut lies between a frame and the next: their proxies differ by the threshold. 0 or less is never."""
    if threshold <= 0:
        return df.withColumn(out, F.lit(False))
    both = next_by_index(df, keys, idx, {proxy: "_next"})
    return both.withColumn(out, F.coalesce(mean_abs_difference(F.col(proxy), F.col("_next")) >= threshold, F.lit(False))).drop("_next")


def luma_proxy(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], size: tuple[int, int], *, to: tuple[int, int] = (48, 64), out: str = "proxy") -> DataFrame:
    """A frame's small luma picture as one row-major array, which ``cut_after`` compares: colours are averaged over areas first."""
    small = area_average(pixels, keys, colours, size, to)
    grey = small.select(*keys, "y", "x", luma(*[F.col(c) for c in colours]).alias("_luma"))
    return to_frames(grey, keys, "_luma", out=out)


def thumbnail(pixels: DataFrame, keys: Sequence[str], colours: Sequence[str], size: tuple[int, int], *, side: int = 48, out: str = "thumb") -> DataFrame:
    """A frame's raw colours at every n-th pixel from the first on, about ``side`` each way, as one array, which
    ``cut_before`` compares."""
    sy, sx = (max(1, n // side) for n in size)
    some = pixels.where((F.col("y") % sy == 0) & (F.col("x") % sx == 0))
    whole = to_frames(some.withColumn("_rgb", F.array(*colours)), keys, "_rgb", out=out)
    return whole.withColumn(out, F.flatten(out))


def cut_before(df: DataFrame, keys: Sequence[str], idx: str, proxy: str, threshold: float, *, out: str = "cut") -> DataFrame:
    """Whether a cut lies before a frame. A first frame, or one after a change of size, has none."""
    before = df.select(*keys, (F.col(idx) + 1).alias(idx), F.col(proxy).alias("_prev"))
    both = df.join(before, [*keys, idx], "left")
    same = F.size("_prev") == F.size(proxy)
    return both.withColumn(out, F.coalesce(same & (mean_abs_difference(F.col(proxy), F.col("_prev")) >= threshold), F.lit(False))).drop("_prev")


def percentile_bounds(pixels: DataFrame, keys: Sequence[str], depth: str, *, low: float = 2.0, high: float = 98.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Exact percentiles of a strided sample of each frame, kept apart by a millionth."""
    stride = max(1, min(size) // 192) if size else 1
    sample = pixels.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)) if stride > 1 else pixels
    found = sample.groupBy(*keys).agg(F.percentile(depth, F.array(F.lit(low / 100), F.lit(high / 100))).alias("_p"))
    lo, hi = F.get("_p", 0), F.get("_p", 1)
    return found.select(*keys, lo.alias("low"), F.when(hi <= lo + 1e-8, lo + 1e-6).otherwise(hi).alias("high"))


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], given: Sequence[str], out: Sequence[tuple[str, str]], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """``df`` with columns from a recursion: ``step(state, *values)`` takes a row's ``given`` columns and gives the next
    state (None at first) and the row's new values. A stream is read in order by one task that holds a batch and one
    state, not the stream. Null keys are a stream like any other."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in out)).fields])
    names = [n for n, _ in out]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, None
        for part in parts:
            if not len(part):
                continue
            begins = np.zeros(len(part), bool)
            begins[0] = before is None
            for k, name in enumerate(keys):
                now = part[name].reset_index(drop=True)
                last = now.shift()
                if before is not None:
                    last = pd.concat([pd.Series([before[k]], dtype=object), now[:-1].astype(object)], ignore_index=True)
                begins |= ~((now.astype(object) == last) | (now.isna() & last.isna())).to_numpy(bool) & (before is not None or np.arange(len(part)) > 0)
            made = []
            for begin, *values in zip(begins.tolist(), *[part[c].tolist() for c in given], strict=True):
                state, new = step(None if begin else state, *values)
                made.append(new)
            before = [part[name].iloc[-1] for name in keys]
            yield part.assign(**{n: list(column) for n, column in zip(names, zip(*made, strict=True), strict=True)})

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Rows whose recursion is computed in one go, and levels of such blocks of blocks: beyond BLOCK**3 rows a stream's uppermost block grows.
BLOCK, LEVELS = 256, 3


def _composed(m: Column, then: Column) -> Column:
    """The step that does m and then another. A step takes the average s to a * s + (low, high), or, where there is none yet, to first."""
    low, high = then["a"] * m["low"] + then["low"], then["a"] * m["high"] + then["high"]
    first = [F.coalesce(then["a"] * m[f] + then[v], then[f]).alias(f) for f, v in (("first_low", "low"), ("first_high", "high"))]
    return F.struct((m["a"] * then["a"]).alias("a"), low.alias("low"), high.alias("high"), *first)


def _applied(state: Column, m: Column) -> Column:
    return F.struct(*[F.when(state[v].isNull(), m[f"first_{v}"]).otherwise(m["a"] * state[v] + m[v]).alias(v) for v in ("low", "high")])


def _states_before(steps: DataFrame, level: int) -> DataFrame:
    """at and state for each stream's steps (stream, at, m): the average before each step, null before the first."""
    block = F.floor(F.col("at") / BLOCK) if level else F.lit(0).cast("long")  # what is left uppermost is one block
    packed = steps.groupBy("stream", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("rows"))
    none = F.lit(None).cast("struct<low: double, high: double>")
    if level:
        nothing = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(None).cast("double").alias("first_low"), F.lit(None).cast("double").alias("first_high"))
        whole = packed.select("stream", F.col("block").alias("at"), F.aggregate("rows", nothing, lambda m, r: _composed(m, r["m"])).alias("m"))
        packed = packed.join(_states_before(whole, level - 1).select("stream", F.col("at").alias("block"), "state"), ["stream", "block"])
    else:
        packed = packed.withColumn("state", none)
    begin = F.struct(F.col("state"), F.array().cast("array<struct<at: bigint, state: struct<low: double, high: double>>>").alias("done"))
    walked = F.aggregate("rows", begin, lambda s, r: F.struct(_applied(s["state"], r["m"]).alias("state"), F.array_append(s["done"], F.struct(r["at"].alias("at"), s["state"].alias("state"))).alias("done")))
    return packed.select("stream", F.inline(walked["done"]))


def smooth_bounds(bounds: DataFrame, keys: Sequence[str], idx: str, *, ema: float = 0.95, cut: str = "cut") -> DataFrame:
    """Running bounds norm_low and norm_high: an average of past and present that starts anew at a cut.

    Every row is a step a * s + b of the average s, and steps compose: blocks of rows are composed side by side, then
    blocks of blocks, so one long stream is spread over the cluster. Rows of a stream have an index each.
    """
    fresh = F.coalesce(F.col(cut), F.lit(False))
    share = F.when(fresh, 1.0).otherwise(1 - ema)
    parts = [F.when(fresh, 0.0).otherwise(ema).alias("a"), *[(share * F.col(c)).alias(c) for c in ("low", "high")], *[F.col(c).cast("double").alias(f"first_{c}") for c in ("low", "high")]]
    stream = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))  # in a struct nulls are equal
    steps = bounds.select(stream.alias("stream"), F.col(idx).cast("long").alias("at"), F.struct(*parts).alias("m"))
    states = _states_before(steps, LEVELS - 1).withColumnsRenamed({"stream": "_stream", "at": "_at", "state": "_state"})
    both = bounds.withColumns({"_stream": stream, "_at": F.col(idx).cast("long"), "_m": F.struct(*parts)}).join(states, ["_stream", "_at"])
    now = _applied(F.col("_state"), F.col("_m"))
    return both.select(*bounds.columns, now["low"].alias("norm_low"), now["high"].alias("norm_high"))


def normalised(depth: Column, low: Column, high: Column, *, inverted: bool = False) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (depth - low) / F.greatest(high - low, F.lit(1e-6))))
    return 1 - v if inverted else v


def stabilise(df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str, *, stability: float = 0.15, threshold: float = 0.2, out: str = "stable") -> DataFrame:
    """Depth fields mixed with the field before as it was mixed; a large change from that starts anew.
    ``depth`` is a number or an array. A stability of 0 leaves all as it is."""
    a = min(0.95, max(0.0, stability))
    kind = df.schema[depth].dataType
    if a <= 0:
        return df.withColumn(out, F.col(depth))

    def step(state, value):
        now = np.asarray(value, float)
        if state is not None and state.shape == now.shape and np.abs(now - state).mean() < max(0.0, threshold):
            now = now + a * (state - now)
        return now, (now.tolist(),)

    return fold(df, keys, order, [depth], [(out, kind.simpleString())], step)


def densify(df: DataFrame, keys: Sequence[str], idx: str, value: str, multiplier: int, *, following: str | None = None, cut: str | None = None, tail: bool = True, between: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Each row and the ``multiplier`` - 1 between it and the next, as keys, out_idx, value and t = j / multiplier.

    ``idx`` counts from 0 without gaps; ``following`` names a column that already holds the next
    value. Across a cut the left value is held; at the end too, with ``tail``, so that n rows give
    n * multiplier, else (n - 1) * multiplier + 1. ``between(a, b, t)`` is linear unless given.
    """
    if not 1 <= multiplier <= 16:
        raise ValueError(f"a multiplier of {multiplier}")
    if multiplier == 1:
        return df.select(*keys, F.col(idx).alias("out_idx"), value, F.lit(0.0).alias("t"))
    both = df if following else next_by_index(df, keys, idx, {value: "_next"})
    after = F.col(following or "_next")
    a, t = F.col(value), F.col("_j") / F.lit(multiplier)
    array = isinstance(df.schema[value].dataType, T.ArrayType)
    linear = (lambda a, b, t: F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)) if array else (lambda a, b, t: a * (1 - t) + b * t)
    hold = after.isNull() | (F.col(cut) if cut else F.lit(False)) | (F.col("_j") == 0)
    places = F.sequence(F.lit(0), F.lit(multiplier - 1)) if tail else F.when(after.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(multiplier - 1)))
    rows = both.withColumn("_j", F.explode(places))
    return rows.select(*keys, (F.col(idx) * multiplier + F.col("_j")).alias("out_idx"), F.when(hold, a).otherwise((between or linear)(a, after, t)).alias(value), t.alias("t"))


def chunked(df: DataFrame, idx: str, size: int) -> DataFrame:
    """Chunks of ``size`` rows by index; the last has what is left."""
    if size < 1:
        raise ValueError(f"chunks of {size}")
    return df.withColumns({"chunk": F.floor(F.col(idx) / size).cast("long"), "place": (F.col(idx) % size).cast("int")})


def hop_windows(frames: DataFrame, keys: Sequence[str], idx: str, values: Sequence[str]) -> DataFrame:
    """Windows of WINDOW frames every STEP; the last frame fills a window that runs past the end."""
    n = frames.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    wins = n.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STEP).cast("long"))))
    cells = wins.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))))
    at = F.col("window") * STEP + F.col("place")
    cells = cells.withColumn(idx, F.least(at, F.col("_n") - 1)).withColumn("padded", at >= F.col("_n"))
    return cells.drop("_n").join(frames.select(*keys, idx, *values), [*keys, idx])


def emission(idx: Column) -> Column:
    """array of struct(window, place, weight): what a frame's output is made of. In a blend the earlier
    window's weight falls from 1 to 0 over BLEND frames while the later one's rises."""
    window = F.greatest(F.lit(0).cast("long"), F.floor((idx - _HEAD) / STEP).cast("long"))
    place = (idx - window * STEP).cast("int")
    share = (place - _HEAD) / F.lit(float(BLEND - 1))
    single = F.array(F.struct(window.alias("window"), place.alias("place"), F.lit(1.0).alias("weight")))
    both = F.array(
        F.struct((window - 1).alias("window"), (place + STEP).alias("place"), (1 - share).alias("weight")),
        F.struct(window.alias("window"), place.alias("place"), share.alias("weight")),
    )
    return F.when((window > 0) & (place < OVERLAP), both).otherwise(single)


def least_squares(df: DataFrame, keys: Sequence[str], prediction: str, target: str) -> DataFrame:
    """scale and shift that take predictions nearest to targets; 1 and 0 where they aren't determined."""
    return df.groupBy(*keys).agg(F.coalesce(F.regr_slope(target, prediction), F.lit(1.0)).alias("scale"), F.coalesce(F.when(F.regr_slope(target, prediction).isNotNull(), F.regr_intercept(target, prediction)), F.lit(0.0)).alias("shift"))


def fit_window(ref: np.ndarray, got: np.ndarray) -> tuple[float, float]:
    """Least squares of one window's alignment frames, in double precision."""
    n, sp, st = len(got), got.sum(), ref.sum()
    det = n * (got * got).sum() - sp * sp
    if det == 0:
        return 1.0, 0.0
    scale = (n * (got * ref).sum() - sp * st) / det
    return float(scale), float((st - scale * sp) / n)


def align_step(state, window: int, first: np.ndarray, second: np.ndarray, twelfth: np.ndarray):
    """The chain's next state (the first window's frame 0, the last aligned frame 12), and scale and shift."""
    if state is None:
        return (first, twelfth), (1.0, 0.0)
    scale, shift = fit_window(np.concatenate(state), np.concatenate([first, second]))
    return (state[0], np.maximum(0, twelfth * scale + shift)), (scale, shift)


def align_chain(windows: DataFrame, keys: Sequence[str], depth: str) -> DataFrame:
    """keys, window, scale and shift. Only places 0, 1 and 12 of a window enter the chain."""
    used = windows.where(F.col("place").isin(0, 1, 12)).groupBy(*keys, "window").agg(*[F.max(F.when(F.col("place") == p, F.col(depth))).alias(f"_p{p}") for p in (0, 1, 12)])

    def step(state, window, *frames):
        return align_step(state, window, *[np.asarray(f, float) for f in frames])

    return fold(used, keys, ["window"], ["window", "_p0", "_p1", "_p12"], [("scale", "double"), ("shift", "double")], step).select(*keys, "window", "scale", "shift")


def blend_windows(windows: DataFrame, keys: Sequence[str], idx: str, depth: str, aligned: DataFrame) -> DataFrame:
    """The stream's depth again: aligned, floored at 0 but for the first window, cross-faded."""
    real = windows.where(~F.col("padded")).withColumn("_e", F.explode(emission(F.col(idx))))
    real = real.where((F.col("_e.window") == F.col("window")) & (F.col("_e.place") == F.col("place")))
    fitted = real.join(aligned, [*keys, "window"])
    value = F.transform(depth, lambda v: F.when(F.col("window") == 0, v).otherwise(F.greatest(F.lit(0.0), v * F.col("scale") + F.col("shift"))) * F.col("_e.weight"))
    parts = fitted.groupBy(*keys, idx).agg(F.collect_list(value).alias("_v"))  # two windows at most
    return parts.select(*keys, idx, F.when(F.size("_v") == 1, F.get("_v", 0)).otherwise(F.zip_with(F.get("_v", 0), F.get("_v", 1), lambda a, b: a + b)).alias(depth))


def keyframe_inputs(window: Column) -> Column:
    """The frames that a window's first OVERLAP inputs come from: frame 0 for ever, then places 12 and 24..31 of
    the window before. Null for the first window, which has none."""
    before = [F.lit(0).cast("long"), *[(window - 1) * STEP + p for p in KEYFRAMES[1:]]]
    return F.when(window > 0, F.array(*before))


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` and what it will have counted when it has run: no second pass. ``.get["n"]`` waits for that."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def verify(seen: Observation, expected: int, what: str = "rows") -> int:
    """Compare what was counted on the way; a difference is an error."""
    found = seen.get["n"]
    if found != expected:
        raise ValueError(f"{found} {what} instead of {expected}")
    return found


def check_count(df: DataFrame, expected: int, what: str = "rows") -> int:
    """Count and compare; a difference is an error."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} {what} instead of {expected}")
    return found
