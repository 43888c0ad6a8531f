"""Models are plain functions; these are the stand-ins, and how a pair or window model is applied."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.pixels import BT709

INTERPOLATION: dict[str, Callable] = {}
DEPTH: dict[str, Callable] = {}


def register(kind: dict[str, Callable], name: str, model: Callable) -> None:
    if name in kind:
        raise ValueError(f"{name} is registered already")
    kind[name] = model


def linear(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return a * (1 - t) + b * t


def luma_depth(window: np.ndarray) -> np.ndarray:
    """[frames, h, w, 3] to [frames, h, w]."""
    return window[..., :3] @ np.array(BT709)


register(INTERPOLATION, "linear", linear)
register(DEPTH, "luma", luma_depth)


def call_pair(model: Callable, a: np.ndarray, b: np.ndarray, t: float, cache: dict | None = None) -> np.ndarray:
    """A model may take a cache; one that doesn't is called without."""
    try:
        return model(a, b, t, cache) if cache is not None else model(a, b, t)
    except TypeError:
        return model(a, b, t)


def run_backend(backend: Callable, frames: np.ndarray, multiplier: int) -> np.ndarray:
    """A sequence backend must give (n - 1) * multiplier + 1 frames."""
    out = backend(frames, multiplier)
    if len(out) != (len(frames) - 1) * multiplier + 1:
        raise ValueError(f"the backend made {len(out)} of {(len(frames) - 1) * multiplier + 1} frames")
    return out


def apply_pairs(pairs: DataFrame, left: str, right: str, t: str, model: Callable, *, out: str = "value") -> DataFrame:
    """A pair model over rows with two arrays and a time, in Arrow batches; a row without a right side keeps its left."""
    schema = T.StructType(list(pairs.schema.fields)).add(out, T.ArrayType(T.DoubleType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cache: dict = {}
            yield part.assign(**{out: [np.asarray(a, float).tolist() if b is None else np.asarray(call_pair(model, np.asarray(a, float), np.asarray(b, float), s, cache)).tolist() for a, b, s in zip(part[left], part[right], part[t], strict=True)]})

    return pairs.mapInPandas(run, schema)


def apply_windows(windows: DataFrame, keys: list[str], rgb: str, shape: tuple[int, int], model: Callable, *, out: str = "depth") -> DataFrame:
    """A depth model over windows: a group is one window, 32 frames by definition."""
    schema = T.StructType([windows.schema[c] for c in [*keys, "window", "place"]]).add(out, T.ArrayType(T.DoubleType()))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        made = model(np.stack([np.asarray(v, float).reshape(*shape, 3) for v in group[rgb]]))
        if len(made) != len(group):
            raise ValueError(f"the model made {len(made)} of {len(group)} frames")
        return group[[*keys, "window", "place"]].assign(**{out: [m.reshape(-1).tolist() for m in made]})

    return windows.groupBy(*keys, "window").applyInPandas(run, schema)
