"""Statistics of whole texts, counted in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, coded, segment_sums, text_slices, words_of

#: Classes of bytes, each counted as a share of the bytes that are not spaces.
_CLASSES = {
    "upper_share": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit_share": b"0123456789",
    "bang_share": b"!",
    "pipe_share": b"|",
    "symbol_share": b"#*$%&<>",
    "stop_share": b".,;:?",
    "other_ascii_share": b"\"'()[]{}-_=+/\\@^~`",
    "beyond_ascii_share": bytes(range(128, 256)),
}
_SPACE_BYTES = b" \t\n\x0b\x0c\r"

STATISTICS = (*_CLASSES, "n_words", "mean_word", "words_per_line", "distinct_share", "next_equal_share", "dup_line_share", "window_repeat_share")


def _class_of() -> np.ndarray:
    to = np.full(256, len(_CLASSES) + 1, np.int64)  # what no class names
    for k, members in enumerate(_CLASSES.values()):
        to[list(members)] = k
    to[list(_SPACE_BYTES)] = len(_CLASSES)
    return to


_CLASS_OF = _class_of()


def windows_of(codes: np.ndarray, n_distinct: int) -> np.ndarray:
    """Numbers that are equal where three following words are: exact below 2**21 distinct words, else 64-bit mixes."""
    c = codes.astype(np.uint64)
    if n_distinct < 1 << 21:
        return (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    mixed = c * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed[:-2] * np.uint64(0xBF58476D1CE4E5B9) ^ mixed[1:-1]) * np.uint64(0x94D049BB133111EB) ^ mixed[2:]


def _repeats(values: np.ndarray) -> int:
    """How many of the values equal another before them."""
    if len(values) < 2:
        return 0
    ordered = np.sort(values)
    return int((ordered[1:] == ordered[:-1]).sum())


def statistics_of(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text. A text without words has zeros everywhere."""
    n = len(texts)
    raw, offsets = buffer_of(texts)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    k = len(_CLASSES) + 2
    counts = np.bincount(doc * k + _CLASS_OF[raw], minlength=n * k).reshape(n, k).astype(float)
    filled = np.maximum(counts.sum(axis=1) - counts[:, len(_CLASSES)], 1)
    flat, starts = words_of(texts)
    codes, distinct = coded(flat)
    n_words = np.diff(starts)
    some = np.maximum(n_words, 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, : len(_CLASSES)] = counts[:, : len(_CLASSES)] / filled[:, None]
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[starts[:-1][n_words > 0]] = 0
    windows = windows_of(codes, len(distinct)) if len(codes) > 2 else np.zeros(0, np.uint64)
    at = len(_CLASSES)
    out[:, at], out[:, at + 1] = n_words, filled / some
    out[:, at + 4] = segment_sums(same, starts) / some
    for i, text in enumerate(texts.to_pylist()):
        s, e = starts[i], starts[i + 1]
        if s == e:
            out[i] = 0
            continue
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        out[i, at + 2] = (e - s) / max(1, len(lines))
        out[i, at + 3] = 1 - _repeats(codes[s:e]) / (e - s)
        out[i, at + 5] = 1 - len(set(lines)) / max(1, len(lines))
        out[i, at + 6] = _repeats(windows[s : e - 2]) / max(1, e - s - 2)
    return out


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the STATISTICS as doubles, one row per row."""
    out = df.select(*keep, F.col(text).alias("_text"))
    schema = out.select(*keep).schema
    for name in STATISTICS:
        schema = schema.add(name, "double")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text", 1 << 20):
            found = statistics_of(texts)
            columns = [part.column(k) for k in range(len(keep))] + [pa.array(found[:, k]) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATISTICS])

    return out.mapInArrow(count, schema)
