"""The graph's nodes by name: what each one is here, and pipelines of them as composed transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..functions import pixels, scalars
from ..operators import layout, models, spatial, temporal, warp
from ..sources import rawframes
from ..streaming import series
from . import encoder

REGISTRY: dict[str, Callable[..., Any]] = {}


def register(name: str, target: Callable[..., Any]) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = target


for _name, _target in {
    "ProductionVideoLoader": rawframes.RawFrames,
    "DepthModelLoader": lambda name="luma": models.DEPTH[name],
    "DepthStream": series.depth_window_stream,
    "DepthTemporalNormalize": temporal.smooth_bounds,
    "DepthPreview": pixels.preview,
    "StereoDIBR": warp.render_stereo,
    "SBSCombine": layout.side_by_side,
    "SessionInfo": lambda query: query.lastProgress,
    "InterpolationModelLoader": lambda name="linear": models.INTERPOLATION[name],
    "FrameInterpolation": lambda df, *a, **k: temporal.densify(df, *a, **{**k, "tail": False}),
    "FrameInterpolationStream": series.densify_stream,
    "EdgeAwareDepthSmooth": spatial.guided_filter,
    "DepthStereoTuning": pixels.tune,
    "ResolutionStereoControls": scalars.stereo_controls,
    "AsyncVideoEncoder": encoder.command,
    "StreamingVideoEncoder": series.run_to_end,
    "AsyncLosslessVideoEncoder": encoder.legacy_command,
    "EncoderCleanup": lambda spark, name: [q.stop() for q in spark.streams.active if q.name == name],
}.items():
    register(_name, _target)


def compose(df: DataFrame, steps: Sequence[tuple[Callable[..., DataFrame], dict[str, Any]]]) -> DataFrame:
    """A pipeline: each step takes the frame before and its own parameters."""
    for step, how in steps:
        df = df.transform(step, **how)
    return df


def stage_profile(seconds: dict[str, float], preferred: Sequence[str]) -> list[tuple[str, float]]:
    """Stages in the preferred order, the rest by name."""
    named = [s for s in preferred if s in seconds]
    return [(s, seconds[s]) for s in [*named, *sorted(set(seconds) - set(named))]]
