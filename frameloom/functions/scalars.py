"""Rates, sizes, counts and names as column expressions. ``bround`` rounds halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rate(text: Column) -> Column:
    """A rational such as 24000/1001, or a plain number; what isn't one gives 0."""
    parts = F.split(F.trim(text), "/")
    num = F.get(parts, 0).try_cast("double")
    den = F.get(parts, 1).try_cast("double")
    ratio = F.when(F.size(parts) == 2, F.try_divide(num, den)).when(F.size(parts) == 1, num)
    return F.coalesce(ratio, F.lit(0.0))


def cadence(source: Column, target: Column) -> Column:
    """struct(multiplier, fps, problem): 1 within max(0.25, 0.5 % of the target), else the whole ratio from 2
    to 16; the output rate is always that many times the source's. ``problem`` says why there is none."""
    near = F.abs(source - target) <= F.greatest(F.lit(0.25), F.abs(target) * 0.005)
    m = F.bround(target / source).cast("int")
    problem = (
        F.when(~(source > 0) | ~(target > 0) | F.isnan(source) | F.isnan(target), F.lit("rate"))
        .when(near, F.lit(None).cast("string"))
        .when(target <= source, F.lit("above target"))
        .when((m < 2) | (m > 16), F.lit("multiplier"))
    )
    good = problem.isNull()
    multiplier = F.when(good & near, F.lit(1)).when(good, m)
    return F.struct(multiplier.alias("multiplier"), F.when(good & near, source).when(good, source * m).alias("fps"), problem.alias("problem"))


def strict_cadence(source: Column, target: Column) -> Column:
    """``cadence``, but a rate without a multiplier stops the query."""
    found = cadence(source, target)
    stop = F.raise_error(F.concat(F.lit("no interpolation multiplier: "), found["problem"])).cast("int")
    return F.struct(F.when(found["problem"].isNull(), found["multiplier"]).otherwise(stop).alias("multiplier"), found["fps"].alias("fps"))


def planned_frames(n: Column, multiplier: Column, has_prior: Column, final: Column) -> Column:
    """Frames that a batch of ``n`` yields: the first batch lacks a frame before it, the final one holds its last."""
    body = F.when(has_prior, n * multiplier).otherwise((n - 1) * multiplier + 1)
    return F.when(n <= 0, F.lit(0)).otherwise(body + F.when(final, multiplier - 1).otherwise(0)).cast("long")


def model_input_size(height: Column, width: Column, size: int = 518) -> Column:
    """struct(h, w): both sides at least ``size`` and multiples of 14; long pictures get a smaller size."""
    ratio = F.greatest(height, width) / F.greatest(F.lit(1), F.least(height, width))
    smaller = F.greatest(F.lit(14), F.bround(F.floor(F.lit(size) * 1.777 / ratio) / 14) * 14)
    base = F.when(ratio > 1.78, smaller).otherwise(F.lit(size)).cast("double")
    scale = F.greatest(base / height, base / width)
    side = lambda v: F.greatest(base, F.bround(v * scale / 14) * 14).cast("int")
    return F.struct(side(height).alias("h"), side(width).alias("w"))


def stereo_controls(source_width: Column, *, half: bool, strength_percent: float = 1.4, zero_parallax: float = 0.0, fill_multiplier: float = 3.0) -> Column:
    """struct(eye_width, max_disparity_eye_px, rendered_eye_px, max_fill_distance, zero_parallax).

    The renderer shifts an eye by half the disparity it is given; rendered_eye_px says so."""
    eye = F.floor(source_width / 2).cast("long") if half else source_width.cast("long")
    px = eye * F.lit(strength_percent / 100)
    fill = F.greatest(F.lit(1), F.bround(px * fill_multiplier).cast("long"))
    return F.struct(eye.alias("eye_width"), px.alias("max_disparity_eye_px"), (px / 2).alias("rendered_eye_px"), fill.alias("max_fill_distance"), F.lit(min(1.0, max(0.0, zero_parallax))).alias("zero_parallax"))


def rate_text(mbps: Column) -> Column:
    """A bit rate as encoders take it, with six significant digits and no trailing zeros: 12.5 is 12.5M, 100 is 100M,
    123.4567 is 123.457M and 0.00001 is 1e-05M; rates of 0 or less give null."""
    parts = F.split(F.format_string("%.5e", mbps), "e")  # rounded to six digits: one, a point, five
    power = F.get(parts, 1).cast("int")
    trimmed = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    scientific = F.concat(trimmed(F.get(parts, 0)), F.lit("e"), F.get(parts, 1))
    digits = F.regexp_replace(F.get(parts, 0), r"\.", "")
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power < 5, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
        .otherwise(F.concat(digits, F.lit(".0")))
    )
    return F.when(mbps > 0, F.concat(F.when((power < -4) | (power > 5), scientific).otherwise(trimmed(plain)), F.lit("M")))


#: What no file name may hold.
RESERVED = r'[<>:"/\\|?*\x00-\x1f]'


def safe_stem(name: Column) -> Column:
    """A file's stem that is valid everywhere: no folder, no extension, no reserved or control character."""
    base = F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    stem = F.when(stem == "", F.when(base == "", F.lit("video")).otherwise(base)).otherwise(stem)
    clean = F.btrim(F.regexp_replace(stem, RESERVED, "_"), F.lit(" ."))
    return F.when(clean == "", F.lit("video")).otherwise(clean)


def output_name(prefix: Column, source: Column, suffix: Column, by_source: Column) -> Column:
    """The path without extension: the prefix itself, or the source's stem and suffix in the prefix's folder."""
    given = F.coalesce(prefix, F.lit(""))
    folder = F.when(given.rlike(r"[/\\]$"), F.regexp_replace(given, r"[/\\]+$", "")).otherwise(F.regexp_replace(F.regexp_extract(given, r"^(.*)/[^/]*$", 1), "(?<=.)/+$", ""))
    stem = F.concat(safe_stem(source), F.regexp_replace(F.coalesce(suffix, F.lit("")), RESERVED, "_"))
    named = F.when(folder == "", stem).otherwise(F.concat_ws("/", folder, stem))
    return F.when(by_source, named).otherwise(given)


def frame_counter(file: Column, stem: str) -> Column:
    """The number in a counted output's name (stem_00012.mp4, also with text after the number), else null."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in stem)
    found = F.regexp_extract(file, rf"(?i)^{quoted}_(\d+)\D*\.mp4$", 1)
    return F.when(found != "", found.cast("long"))


def free_output(stem: Column, taken: Column, extension: str = ".mp4") -> Column:
    """The stem if no file of an output folder (``taken``, an array of names) has it, else with (2), (3) and so on."""
    numbered = lambda n: F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"))
    is_free = lambda name: ~F.array_contains(taken, F.concat(name, F.lit(extension)))
    n = F.get(F.filter(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: is_free(numbered(k))), 0)
    return F.when(is_free(stem), stem).otherwise(numbered(n))


def model_rank(name: Column) -> Column:
    """What models are ordered by: release 4.25 first, then 4.26, then the rest by name."""
    low = F.lower(name)
    return F.struct(F.when(low.rlike(r"4\.?25"), 0).when(low.rlike(r"4\.?26"), 1).otherwise(2), low)
