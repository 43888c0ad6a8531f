"""Encoder settings: what is valid, and the encoder's command as data. Nothing is run here.

The validity matrix is a table that queries can join; commands are put together from one table of
codecs, so that a test reads them without an encoder.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, which encoders define: codecs with their encoder, output label and pixel formats by bit depth.
CODECS = {
    "x264": ("libx264", "video/h264-mp4", {"8bit": "yuv420p", "10bit": "yuv420p10le"}),
    "x265": ("libx265", "video/h265-mp4", {"8bit": "yuv420p", "10bit": "yuv420p10le"}),
    "av1": ("libsvtav1", "video/av1-mp4", {"8bit": "yuv420p", "10bit": "yuv420p10le"}),
    "av1_vaapi": ("av1_vaapi", "video/av1-mp4", {"8bit": "nv12", "10bit": "p010le"}),
}
#: Rate controls that each codec takes, and the bounds of its quality setting.
MODES = {
    "x264": {"lossless": None, "constant_quality": (0, 51), "vbr": None},
    "x265": {"lossless": None, "constant_quality": (0, 51), "vbr": None},
    "av1": {"constant_quality": (0, 63), "vbr": None},
    "av1_vaapi": {"constant_quality": (1, 255), "cqp": (1, 255), "vbr": None},
}
RATE_CONTROLS = ("lossless", "constant_quality", "cqp", "vbr")
#: Software presets, fast to slow, and the number that the software AV1 encoder has for each.
SOFTWARE_PRESETS = {"ultrafast": 13, "superfast": 12, "veryfast": 11, "faster": 10, "fast": 9, "medium": 8, "slow": 6, "slower": 4, "veryslow": 2}
LEGACY_PRESETS = ("lossless_x264_qp0", "av1_vaapi_150m_10bit")


@dataclass(frozen=True)
class Settings:
    """An encoder's settings. The defaults are fixed values, those of the graph's encoder node."""

    codec: str = "x264"
    bit_depth: str = "10bit"
    rate_control: str = "constant_quality"
    crf: float = 16.0
    av1_qp: int = 60
    bitrate_mbps: float = 100.0
    maxrate_mbps: float = 135.0
    bufsize_mbps: float = 280.0
    software_preset: str = "medium"
    vaapi_device: str = "/dev/dri/renderD128"

    def signature(self) -> tuple:
        """What must stay the same while a stream is written; numbers to six places."""
        return tuple(round(v, 6) if isinstance(v, float) else v for v in astuple(self))


def problem(s: Settings) -> str | None:
    """Why the settings are refused, or None."""
    for value, known, what in ((s.codec, CODECS, "codec"), (s.bit_depth, ("8bit", "10bit"), "bit depth"), (s.rate_control, RATE_CONTROLS, "rate control"), (s.software_preset, SOFTWARE_PRESETS, "preset")):
        if value not in known:
            return f"unknown {what} {value}"
    if s.rate_control not in MODES[s.codec]:
        return f"{s.codec} has no {s.rate_control}"
    bounds = MODES[s.codec][s.rate_control]
    quality = s.av1_qp if s.codec == "av1_vaapi" else s.crf
    if bounds and not bounds[0] <= quality <= bounds[1]:
        return f"quality {quality:g} is outside {bounds[0]}..{bounds[1]}"
    if s.codec == "av1_vaapi" and not s.vaapi_device:
        return "no device"
    if s.rate_control == "vbr":
        if min(s.bitrate_mbps, s.maxrate_mbps, s.bufsize_mbps) <= 0:
            return "rates must be above 0"
        if s.maxrate_mbps < s.bitrate_mbps:
            return "the greatest rate is below the rate"
    return None


def mbps(value: float) -> str:
    if value <= 0:
        raise ValueError(f"a rate of {value}")
    return f"{value:g}M"


#: Fixed values, which the encoder's command line defines: arguments before the raw format, between it and the size, and after the rate.
QUIET = ["-v", "error", "-y"]
RAW_INPUT = ["-f", "rawvideo", "-pix_fmt"]
RAW_COLOUR = ["-color_range", "pc", "-colorspace", "rgb", "-color_primaries", "bt709", "-color_trc", "bt709", "-s"]
RAW_END = ["-i", "-"]
OUTPUT_COLOUR = ["-color_range", "tv", "-colorspace", "bt709", "-color_primaries", "bt709", "-color_trc", "bt709", "-movflags", "+faststart"]
DEVICE = ["-init_hw_device", "vaapi=foo:{device}", "-filter_hw_device", "foo"]
COLOUR_FILTER = "scale=out_color_matrix=bt709:out_range=tv"
#: Quality arguments by rate control and codec; {crf} is the setting, {whole} the setting as a whole number.
QUALITY = {
    ("lossless", "x264"): ["-qp", "0"],
    ("lossless", "x265"): ["-x265-params", "lossless=1"],
    ("constant_quality", "x264"): ["-crf", "{crf}"],
    ("constant_quality", "x265"): ["-crf", "{crf}"],
    ("constant_quality", "av1"): ["-crf", "{whole}"],
}
#: What the two older presets put between input and output.
LEGACY_LOSSLESS = ["-c:v", "libx264", "-preset", "ultrafast", "-qp", "0", "-pix_fmt"]
LEGACY_HARDWARE = ["-c:v", "av1_vaapi", "-b:v", "150M", "-maxrate", "150M", "-bufsize", "300M", "-rc_mode", "VBR"]


def _filled(arguments: list[str], **values: str) -> list[str]:
    return [a.format(**values) for a in arguments]


def _whole(tool: str, device: list[str], fmt: str, size: tuple[int, int], rate: float, mode: list[str], path: str) -> list[str]:
    """A command: the tool, raw frames on its input, what is done with them, and where they go."""
    given = [*RAW_INPUT, fmt, *RAW_COLOUR, "x".join(map(str, size)), "-r", str(float(rate)), *RAW_END]
    return [tool, *QUIET, *device, *given, *mode, *OUTPUT_COLOUR, path]


def command(tool: str, rate: float, width: int, height: int, path: str, s: Settings) -> list[str]:
    """The encoder's arguments, from raw frames on its input to a video without sound."""
    if why := problem(s):
        raise ValueError(why)
    encoder, _, formats = CODECS[s.codec]
    hardware, fmt = s.codec == "av1_vaapi", formats[s.bit_depth]
    rates = ["-b:v", mbps(s.bitrate_mbps), "-maxrate", mbps(s.maxrate_mbps), "-bufsize", mbps(s.bufsize_mbps)] if s.rate_control == "vbr" else []
    if s.codec == "av1":
        rates = rates[:2]  # this encoder takes bounds with a quality setting only
    if hardware:
        mode = ["-rc_mode", "VBR", *rates] if rates else ["-rc_mode", "CQP", "-global_quality", str(int(s.av1_qp))]
    else:
        preset = str(SOFTWARE_PRESETS[s.software_preset]) if s.codec == "av1" else s.software_preset
        quality = rates or _filled(QUALITY[s.rate_control, s.codec], crf=f"{float(s.crf):g}", whole=str(round(s.crf)))
        mode = ["-preset", preset, *quality, "-pix_fmt", fmt]
    scale = ",".join([COLOUR_FILTER, f"format={fmt}", *(["hwupload"] if hardware else [])])
    device = _filled(DEVICE, device=s.vaapi_device) if hardware else []
    raw = "rgb48le" if s.bit_depth == "10bit" else "rgb24"
    return _whole(tool, device, raw, (width, height), rate, ["-vf", scale, "-c:v", encoder, *mode], path)


def legacy_command(tool: str, rate: float, width: int, height: int, path: str, preset: str, pixel_format: str = "yuv420p") -> list[str]:
    """The two older presets, which always take 8-bit input."""
    if preset == LEGACY_PRESETS[0]:
        return _whole(tool, [], "rgb24", (width, height), rate, ["-vf", COLOUR_FILTER, *LEGACY_LOSSLESS, pixel_format], path)
    if preset == LEGACY_PRESETS[1]:
        device = _filled(DEVICE, device=Settings.vaapi_device)
        return _whole(tool, device, "rgb24", (width, height), rate, ["-vf", f"{COLOUR_FILTER},format=p010le,hwupload", *LEGACY_HARDWARE], path)
    raise ValueError(f"unknown preset {preset}")


def codecs(spark: SparkSession) -> DataFrame:
    """codec, bit_depth, encoder, label and pix_fmt: the table that options are looked up in."""
    rows = [(c, depth, name, label, fmt) for c, (name, label, formats) in CODECS.items() for depth, fmt in formats.items()]
    return spark.createDataFrame(rows, "codec string, bit_depth string, encoder string, label string, pix_fmt string")


def matrix(spark: SparkSession) -> DataFrame:
    """codec, rate_control, valid, quality_min and quality_max: a row per pair."""
    rows = [(c, r, r in MODES[c], *(MODES[c].get(r) or (None, None))) for c in CODECS for r in RATE_CONTROLS]
    return spark.createDataFrame(rows, "codec string, rate_control string, valid boolean, quality_min int, quality_max int")


def with_settings(s: Settings, **changes) -> Settings:
    return replace(s, **changes)
