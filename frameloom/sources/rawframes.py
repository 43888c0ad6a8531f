"""Raw frames as a Spark data source.

``spark.dataSource.register(RawFrames)``, then ``spark.read.format("rawframes")`` with the options
path (the path or URI of a file, or of a folder that the sink wrote), width, height, pix_fmt (rgb24 or rgb48le) and, if wanted, frame_load_cap,
frames_per_partition (44), total_frames (a container's estimate, which the file's true end corrects)
and color_matrix (bt709). As a stream it gives frames_per_batch (44) frames a trigger. A size that isn't
whole frames, a missing file and a first frame that can't be read are refused before any row.

``df.write.format("rawframes")`` takes rows of out_idx, data in order of out_idx and writes whole
frames to part files whose order is the stream's order, with a manifest; the option expected_frames
makes a wrong count an error, in which case nothing is left behind. ``df.writeStream`` does the same batch by
batch: a batch must go on where the one before ended, one that is run again replaces itself, and ``finish`` holds
the frames of the whole stream against their expected number.

Options that this source can't follow, a rate or a size other than the file's own, are refused: see
``operators.layout.decode_chain`` for those.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a pixel by raw format.
PIXEL_BYTES = {"rgb24": 3, "rgb48le": 6}
SCHEMA = "frame_idx long, pix_fmt string, w int, h int, data binary, is_last boolean"


def _store(path: str):
    """A path's file system and its path there; plain paths are local."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class SourceError(ValueError):
    """The source can't be read as asked."""


@dataclass
class _Range(InputPartition):
    first: int
    last: int
    end: int


class _Frames:
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.pix_fmt = options.get("pix_fmt", "rgb24")
        if self.pix_fmt not in PIXEL_BYTES:
            raise SourceError(f"pix_fmt {self.pix_fmt}")
        if options.get("color_matrix", "bt709") != "bt709":
            raise SourceError("raw frames are taken as BT.709")
        if float(options.get("start_time", 0)):
            raise SourceError("a start time other than 0 isn't supported")
        for name in ("force_rate", "custom_width", "custom_height"):
            if float(options.get(name, 0) or 0):
                raise SourceError(f"{name} isn't followed by the raw source; use decode_chain on its frames")
        self.w, self.h = int(options.get("width", 0)), int(options.get("height", 0))
        if self.w <= 0 or self.h <= 0:
            raise SourceError(f"frames of {self.w} x {self.h}")
        self.bytes = self.w * self.h * PIXEL_BYTES[self.pix_fmt]
        cap = int(options.get("frame_load_cap", 0))
        self.files = self._files()  # whatever a container estimates
        self.total = sum(n for _, n in self.files)
        self.total = min(self.total, cap) if cap else self.total
        self.per = max(1, int(options.get("frames_per_partition", 44)))
        if self.total:
            next(self.rows(0, 1))

    def _files(self) -> list[tuple[str, int]]:
        """Files and their numbers of frames, in order."""
        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = _manifest(store, at)
            if not found["files"]:
                raise SourceError(f"no finished frames in {self.path}")
            return [(f"{at}/{name}", n) for name, n, *_ in found["files"]]
        if info.type != fs.FileType.File:
            raise SourceError(f"no file at {self.path}")
        if info.size % self.bytes:
            raise SourceError(f"{info.size % self.bytes} bytes after the last whole frame of {self.path}")
        return [(at, info.size // self.bytes)]

    def rows(self, first: int, last: int) -> Iterator[tuple]:
        store, _ = _store(self.path)
        begin = 0
        for name, n in self.files:
            own = range(max(first, begin), min(last, begin + n))
            if len(own):
                with store.open_input_file(name) as f:
                    f.seek((own[0] - begin) * self.bytes)
                    for k in own:
                        data = f.read(self.bytes)
                        if len(data) != self.bytes:
                            raise SourceError(f"frame {k} of {name} has {len(data)} bytes")
                        yield k, self.pix_fmt, self.w, self.h, bytes(data), k == self.total - 1
            begin += n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.frames = _Frames(options)

    def partitions(self):
        n, per = self.frames.total, self.frames.per
        return [_Range(k, min(n, k + per), n) for k in range(0, n, per)] or [_Range(0, 0, 0)]

    def read(self, partition):
        yield from self.frames.rows(partition.first, partition.last)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.frames, self.step = _Frames(options), max(1, int(options.get("frames_per_batch", 44)))
        self.at = 0

    def initialOffset(self):
        return {"frame": 0}

    def latestOffset(self):
        self.at = min(self.frames.total, self.at + self.step)
        return {"frame": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["frame"])
        return [_Range(start["frame"], end["frame"], self.frames.total)]

    def read(self, partition):
        yield from self.frames.rows(partition.first, partition.last)


@dataclass
class _Part(WriterCommitMessage):
    file: str
    frames: int
    partition: int
    first: int | None
    last: int | None


def _manifest(store, base: str) -> dict:
    """frames, and per file in the stream's order its name, frames and, of a stream's sink, batch."""
    if store.get_file_info(f"{base}/manifest.json").type != fs.FileType.File:
        return {"frames": 0, "files": []}
    with store.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def _write_manifest(store, base: str, files: list[list]) -> None:
    with store.open_output_stream(f"{base}/.manifest.json") as out:
        out.write(json.dumps({"frames": sum(f[1] for f in files), "files": files}).encode())
    store.move(f"{base}/.manifest.json", f"{base}/manifest.json")


class _PartWriter:
    def __init__(self, options: dict):
        self.path, self.expected, self.run = options.get("path") or "", options.get("expected_frames"), uuid.uuid4().hex[:12]
        if not self.path:
            raise SourceError("no path")

    def write(self, rows):
        task = TaskContext.get()
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        name, n, first, before = f"part-{task.partitionId():010d}-{self.run}-{task.taskAttemptId()}.raw", 0, None, None
        with store.open_output_stream(f"{base}/{name}") as out:
            for row in rows:
                if before is not None and row.out_idx <= before:
                    raise SourceError(f"frame {row.out_idx} after {before}: rows must come in order")
                first, before = row.out_idx if first is None else first, row.out_idx
                out.write(bytes(row.data))
                n += 1
        return _Part(name, n, task.partitionId(), first, before)

    def remove(self, messages) -> None:
        store, base = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{base}/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{base}/{m.file}")


class _Writer(_PartWriter, DataSourceWriter):
    def commit(self, messages):
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        total = sum(m.frames for m in parts)
        if self.expected is not None and int(self.expected) != total:
            self.abort(messages)
            raise SourceError(f"{total} frames written instead of {self.expected}")
        _write_manifest(*_store(self.path), [[m.file, m.frames] for m in parts])

    def abort(self, messages):
        store, base = _store(self.path)
        for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if self.run in found.base_name:  # files of tasks that failed too
                store.delete_file(found.path)


class _StreamWriter(_PartWriter, DataSourceStreamWriter):
    """Batch by batch: a batch's parts follow one another by their first frames and go on where the batch before ended."""

    def commit(self, messages, batchId):
        store, base = _store(self.path)
        done = [f for f in _manifest(store, base)["files"] if f[2] < batchId]  # a batch that is run again replaces itself
        at = sum(f[1] for f in done)
        parts = sorted((m for m in messages if m and m.frames), key=lambda m: m.first)
        for m in parts:
            if m.first != at or m.last != at + m.frames - 1:
                self.abort(messages, batchId)
                raise SourceError(f"batch {batchId} has frames {m.first}..{m.last} where {at} comes next")
            at += m.frames
        if self.expected is not None and at > int(self.expected):
            self.abort(messages, batchId)
            raise SourceError(f"{at} frames written instead of {self.expected}")
        _write_manifest(store, base, [*done, *[[m.file, m.frames, batchId] for m in parts]])
        self.remove([m for m in messages if m and not m.frames])

    def abort(self, messages, batchId):
        self.remove(messages)


def finish(path: str, expected: int) -> int:
    """After a stream's end: its frames in the sink's folder, an error if they aren't as many as expected."""
    found = _manifest(*_store(path))["frames"]
    if found != expected:
        raise SourceError(f"{found} frames written instead of {expected}")
    return found


class RawFrames(DataSource):
    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options)


def write_ordered(df: DataFrame, path: str, *, idx: str = "out_idx", data: str = "data", partitions: int = 8, expected: int | None = None) -> None:
    """Sort by ranges of the index, so that part files in their order are the stream, and write."""
    df.sparkSession.dataSource.register(RawFrames)
    rows = df.select(F.col(idx).cast("long").alias("out_idx"), F.col(data).alias("data")).repartitionByRange(partitions, "out_idx").sortWithinPartitions("out_idx")
    writer = rows.write.format("rawframes").mode("append").option("path", path)
    (writer.option("expected_frames", str(expected)) if expected is not None else writer).save()


def unpack(frames: DataFrame, *, out: str = "rgb") -> DataFrame:
    """Raw bytes as values in 0..1, row-major with three channels, whatever their depth."""
    schema = T.StructType(list(frames.schema.fields)).add(out, T.ArrayType(T.FloatType()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds = {"rgb24": ("u1", 255), "rgb48le": ("<u2", 65535)}
            yield part.assign(**{out: [(np.frombuffer(d, kinds[p][0]) / np.float32(kinds[p][1])).astype(np.float32) for d, p in zip(part["data"], part["pix_fmt"], strict=True)]})

    return frames.mapInPandas(run, schema)


def pack(frames: DataFrame, values: str, pix_fmt: str = "rgb24", *, out: str = "data", half: bool = False) -> DataFrame:
    """Values in 0..1 as raw bytes, halves up. ``half`` quantises 8-bit values in half precision, 16-bit ones never."""
    if pix_fmt not in PIXEL_BYTES:
        raise SourceError(f"pix_fmt {pix_fmt}")
    schema = T.StructType(list(frames.schema.fields)).add(out, "binary")
    kind, top = ("u1", 255) if pix_fmt == "rgb24" else ("<u2", 65535)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.float16 if half and pix_fmt == "rgb24" else np.float64
        for part in parts:
            yield part.assign(**{out: [np.floor(np.clip(np.asarray(v, number), 0, 1) * number(top) + number(0.5)).astype(kind).tobytes() for v in part[values]]})

    return frames.mapInPandas(run, schema)


#: Extensions of the inputs that are listed.
INPUT_EXTENSIONS = ("webm", "mp4", "mkv", "gif", "mov")


def list_inputs(spark, folder: str) -> DataFrame:
    """path, bytes and change token (path:size:time in ns) of a folder's videos, by name; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(INPUT_EXTENSIONS) + "}").load(folder)
    token = F.concat_ws(":", "path", "length", F.unix_micros("modificationTime") * 1000)
    return found.select("path", "length", token.alias("token")).orderBy("path")


_PROBE = "struct<streams: array<struct<width: int, height: int, avg_frame_rate: string, r_frame_rate: string, nb_frames: string, pix_fmt: string, codec_name: string, color_space: string>>, format: struct<duration: string>>"


def probe(text: Column) -> Column:
    """A probe's JSON as struct(width, height, fps, duration, total_frames, pix_fmt, codec_name, ten_bit, color_space)."""
    from ..functions.scalars import parse_rate

    found = F.from_json(text, _PROBE)
    first = F.get(found["streams"], 0)
    rate = lambda c: F.nullif(parse_rate(c), F.lit(0.0))
    fps = F.coalesce(rate(first["avg_frame_rate"]), rate(first["r_frame_rate"]), F.lit(1.0))
    seconds = F.coalesce(found["format"]["duration"].try_cast("double"), F.lit(0.0))
    counted = F.coalesce(first["nb_frames"].try_cast("long"), F.lit(0))
    frames = F.when(counted > 0, counted).when(seconds > 0, F.bround(seconds * fps).cast("long")).otherwise(F.lit(0).cast("long"))
    pix = F.lower(F.coalesce(first["pix_fmt"], F.lit("")))
    return F.struct(
        first["width"].alias("width"),
        first["height"].alias("height"),
        fps.alias("fps"),
        F.when(seconds > 0, seconds).when(frames > 0, frames / fps).otherwise(seconds).alias("duration"),
        frames.alias("total_frames"),
        pix.alias("pix_fmt"),
        F.lower(F.coalesce(first["codec_name"], F.lit("unknown"))).alias("codec_name"),
        pix.rlike("10|12|16").alias("ten_bit"),
        F.lower(F.coalesce(first["color_space"], F.lit("unknown"))).alias("color_space"),
    )


def raw_format(ten_bit: Column) -> Column:
    return F.when(ten_bit, F.struct(F.lit("rgb48le").alias("pix_fmt"), F.lit(6).alias("bytes"))).otherwise(F.struct(F.lit("rgb24").alias("pix_fmt"), F.lit(3).alias("bytes")))
