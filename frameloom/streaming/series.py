"""Stateful streams: densification, running bounds and depth windows, with the batch operators' arithmetic.

Rows carry stream_id, idx and is_eof; an end row (is_eof) closes a stream whatever the source promised.
There is no time in these streams, so state has no time to live: a stream's end, or a new checkpoint
for a new run, is what clears it. State is one row a stream (the last frame, counters, the settings' signature) or, for windows, the
frames that no window has used up. Streams of numbers share calls by groups, as a call takes longer than a short stream's rows.
Spark sorts a micro-batch's rows, so a processor holds a part of them only. The state store must be RocksDB, and Spark's check of
unsupported operations off (``run_to_end`` sees to both). However a stream is cut into micro-batches, the rows that come out are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.temporal import BLEND, OVERLAP, STEP, WINDOW, align_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How a stream whose settings change goes on: an error, a new session, or a new state without a word.
ON_CHANGE = ("error", "new", "silent")


class Signature:
    """What a stream's settings were when it began."""

    def __init__(self, value: str, on_change: str = "error"):
        if on_change not in ON_CHANGE:
            raise ValueError(on_change)
        self.value, self.on_change = value, on_change

    def carries_on(self, held: str) -> bool:
        """Whether the state that was held under ``held`` is used further."""
        if held == self.value:
            return True
        if self.on_change == "error":
            raise ValueError(f"settings changed within a stream: {held} to {self.value}")
        return False


def _fields(values: list[Any]) -> pd.Series:
    """A column of arrays, also where there are none."""
    column = np.empty(len(values), object)
    column[:] = values
    return pd.Series(column)


#: Numbers that a processor hands on at once where rows are frames.
_NUMBERS = 1 << 20
#: Groups that streams of numbers are dealt to: a call, a read and a write of state for a group and a micro-batch, not for a stream.
GROUPS = 512


def _dealt(rows: DataFrame, groups: int | None) -> GroupedData:
    """Groups of streams, or each stream by itself, with their rows sorted by stream, end and index. Spark keeps the order within
    a group as the order begins with the group; it sorts on disk what memory doesn't hold."""
    given = rows.withColumn("stream_id", F.col("stream_id").cast("string"))
    given = given.withColumn("_group", F.pmod(F.xxhash64("stream_id"), F.lit(groups)) if groups else F.col("stream_id"))
    return given.repartition("_group").sortWithinPartitions("_group", "stream_id", "is_eof", "idx").groupBy("_group")


#: A stream's rows in a part of a group's: its number as text, from where to where, and whether the rest of them are its end.
Run = tuple[Any, int, int, bool]


def _parts(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[dict[str, np.ndarray], list[Run]]]:
    """A part's columns and runs. Rows out of order, which a sort before would have mended, are an error."""
    at: dict[Any, float] = {}
    for part in rows:
        columns = {name: part[name].to_numpy() for name in part.columns}
        ids, idx, end = columns["stream_id"], columns["idx"], columns["is_eof"].astype(bool)
        columns["is_eof"] = end
        begins = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).tolist()
        fall = (end[:-1] & ~end[1:]) | (~end[1:] & (idx[1:] < idx[:-1]))
        fall[np.array(begins[1:-1], int) - 1] = False
        runs: list[Run] = []
        for a, b in pairwise(begins):
            stream, real = ids[a], b - int(end[a:b].sum())
            if real > a:
                if idx[a] < at.get(stream, -np.inf) or fall[a : b - 1].any():
                    raise ValueError(f"rows of stream {stream} are not in order")
                at[stream] = idx[real - 1]
            if real < b:
                at[stream] = np.inf
            runs.append((stream, a, real, real < b))
        yield columns, runs


class SeriesProcessor(StatefulProcessor):
    """What all have in common: of a group's rows a part is held, and of each of its streams the state."""

    fields = ""
    signature = Signature("")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("streams", f"stream_id string, signature string, {self.fields}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        states = {stream: tuple(rest) for stream, *rest in self.state.get()}
        held = bool(states)
        for columns, runs in _parts(rows):
            yield from self.part(states, columns, runs)
        if states:
            self.state.put([(stream, *rest) for stream, rest in states.items()])
        elif held:
            self.state.clear()

    def part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def held(self, states: dict[Any, tuple], stream: Any) -> tuple | None:
        """A stream's state, if it has one that is used further."""
        mark, *state = states.get(stream, (None,))
        return tuple(state) if mark is not None and self.signature.carries_on(mark) else None

    def keep(self, states: dict[Any, tuple], stream: Any, state: tuple | None) -> None:
        """None where a stream has ended, or has had no row."""
        if state is None:
            states.pop(stream, None)
        else:
            states[stream] = (self.signature.value, *state)

    def close(self) -> None:
        pass


class DensifyProcessor(SeriesProcessor):
    """Rows stream_id, out_idx, v: ``multiplier`` - 1 linear steps between neighbours, cuts held, and the last
    row held at the end of the stream if there is a tail. v is a number, or with ``frames`` an array, whose
    mean absolute difference makes a cut."""

    def __init__(self, multiplier: int, threshold: float = 0.0, tail: bool = True, on_change: str = "error", frames: bool = False):
        self.multiplier, self.threshold, self.tail, self.frames = multiplier, threshold, tail, frames
        self.signature = Signature(f"{multiplier}|{threshold}|{tail}|{frames}", on_change)
        self.fields = f"last {'array<double>' if frames else 'double'}, n long, out long"

    def part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        return (self._fields_part if self.frames else self._numbers_part)(states, columns, runs)

    def _numbers_part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        """All streams of a part in one go."""
        m, v, end = self.multiplier, columns["v"].astype(float), columns["is_eof"]
        before, known = np.concatenate([[np.nan], v[:-1]]), np.ones(len(v), bool)
        known[1:] &= ~(end[:-1] & end[1:])  # a stream's second end gives nothing
        states_before = []
        for stream, a, _, _ in runs:
            last, n, out = self.held(states, stream) or (None, 0, 0)
            before[a], known[a] = (np.nan, False) if last is None else (last, True)
            states_before.append((last, n, out))
        made = np.where(end, (m - 1) * self.tail * known, np.where(known, m, 1))
        first = np.cumsum(made) - made
        shift = np.zeros(len(v), int)
        for (stream, a, b, ended), (last, n, out) in zip(runs, states_before, strict=True):
            shift[a : b + 1 if ended else b] = out - first[a]
            state = (float(v[b - 1]), n + b - a, out + int(first[b - 1] + made[b - 1] - first[a])) if b > a else None
            self.keep(states, stream, None if ended else state)
        row = np.repeat(np.arange(len(v)), made)
        at = np.arange(len(row))
        j = at - first[row] + np.where(known, 1, m)[row]
        cut = (np.abs(v - before) >= self.threshold)[row] if self.threshold > 0 else np.zeros(len(row), bool)
        a, b = before[row], v[row]
        value = np.where(end[row] | (cut & (j < m)), a, np.where(j == m, b, a * (1 - j / m) + b * (j / m)))
        yield pd.DataFrame({"stream_id": columns["stream_id"][row], "out_idx": at + shift[row], "v": value})

    def _dense(self, given: np.ndarray, ended: bool, last: Any) -> Iterator[tuple[Any, bool]]:
        """Each frame that comes out, and whether it is one of the input's."""
        m = self.multiplier
        for v in given:
            v = np.asarray(v, float)
            if last is not None:
                cut = self.threshold > 0 and np.mean(np.abs(v - last)) >= self.threshold
                yield from ((last if cut else last * (1 - j / m) + v * (j / m), False) for j in range(1, m))
            last = v
            yield v, True
        if ended and last is not None and self.tail:
            yield from [(last, False)] * (m - 1)

    def _fields_part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        for stream, a, b, ended in runs:
            last, n, out = self.held(states, stream) or (None, 0, 0)
            last = None if last is None else np.array(last, float)
            part = max(1, _NUMBERS // max(1, len(columns["v"][a]))) if b > a else _NUMBERS
            made: list[Any] = []
            for v, real in self._dense(columns["v"][a:b], ended, last):
                made.append(v)
                if real:
                    last, n = v, n + 1
                if len(made) == part:  # parts, so that no frame of the whole output is made
                    yield self._rows(stream, out, made)
                    out, made = out + len(made), []
            yield self._rows(stream, out, made)
            self.keep(states, stream, None if ended or last is None else (last.tolist(), n, out + len(made)))

    def _rows(self, stream: Any, out: int, made: list[Any]) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [stream] * len(made), "out_idx": np.arange(out, out + len(made)), "v": _fields(made)})


class StabilityProcessor(SeriesProcessor):
    """Rows stream_id, idx, stable from v, an array: mixed with the field before as it was mixed, unless that is far."""

    fields = "last array<double>"

    def __init__(self, stability: float = 0.15, threshold: float = 0.2):
        self.stability, self.threshold = min(0.95, max(0.0, stability)), max(0.0, threshold)

    def part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        made = []
        for stream, a, b, ended in runs:
            state = self.held(states, stream)
            last = np.array(state[0], float) if state else None
            for value in columns["v"][a:b]:
                now = np.asarray(value, float)
                if last is not None and last.shape == now.shape and np.abs(now - last).mean() < self.threshold:
                    now = now + self.stability * (last - now)
                last = now
                made.append(now)
            self.keep(states, stream, None if ended or last is None else (last.tolist(),))
        real = ~columns["is_eof"]
        yield pd.DataFrame({"stream_id": columns["stream_id"][real], "idx": columns["idx"][real], "stable": _fields(made)})


class BoundsProcessor(SeriesProcessor):
    """Rows stream_id, idx, norm_low, norm_high from low, high and cut: an average that starts anew at cuts."""

    fields = "low double, high double"

    def __init__(self, ema: float = 0.95):
        self.ema = ema

    def part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        keep, share = self.ema, 1 - self.ema
        given = list(zip(*[columns[c].tolist() for c in ("low", "high", "cut")], strict=True))
        lows, highs = [], []
        for stream, a, b, ended in runs:
            held = self.held(states, stream)
            for low, high, cut in given[a:b]:
                held = (low, high) if held is None or cut else (keep * held[0] + share * low, keep * held[1] + share * high)
                lows.append(held[0])
                highs.append(held[1])
            self.keep(states, stream, None if ended or held is None else tuple(map(float, held)))
        real = ~columns["is_eof"]
        yield pd.DataFrame({"stream_id": columns["stream_id"][real], "idx": columns["idx"][real], "norm_low": np.array(lows, float), "norm_high": np.array(highs, float)})


class DepthWindowCore:
    """The window stream without Spark: ``push`` frames, get (idx, depth) as soon as they are final.

    A window waits for its 32 frames or for the end; its last 8 are held until the next window has
    been blended in. At the end the last frame fills the last window.
    """

    def __init__(self, model):
        self.model = model  # [32, cells] to [32, cells]
        self.frames: list[np.ndarray] = []  # from frame ``first`` on
        self.first = self.window = 0
        self.chain: tuple | None = None
        self.pending: list[np.ndarray] = []

    def push(self, frames: list[np.ndarray], ended: bool) -> list[tuple[int, np.ndarray]]:
        self.frames += frames
        out: list[tuple[int, np.ndarray]] = []
        while self.frames and (len(self.frames) > WINDOW - 1 or ended):
            total = self.first + len(self.frames)
            last = ended and self.first + STEP >= total
            # a full window may be the last one: only the next frame or the end tells
            if not ended and len(self.frames) < WINDOW:
                break
            given = self.frames[:WINDOW]
            depth = np.asarray(self.model(np.stack(given + [given[-1]] * (WINDOW - len(given)))), float)
            out += self._emit(depth, len(given), last)
            if last:
                self.frames = []
                break
            self.frames, self.first, self.window = self.frames[STEP:], self.first + STEP, self.window + 1
        return out

    def _emit(self, depth: np.ndarray, real: int, last: bool) -> list[tuple[int, np.ndarray]]:
        begin, out = self.first, []
        self.chain, (scale, shift) = align_step(self.chain, self.window, depth[0], depth[1], depth[12])
        if self.window:
            depth = np.maximum(0, depth * scale + shift)
            for k, before in enumerate(self.pending):
                w = k / (BLEND - 1)
                out.append((begin + OVERLAP - BLEND + k, before * (1 - w) + depth[OVERLAP - BLEND + k] * w))
        stable = range(OVERLAP if self.window else 0, min(real, WINDOW if last else WINDOW - BLEND))
        out += [(begin + p, depth[p]) for p in stable]
        self.pending = [] if last else [depth[p] for p in range(WINDOW - BLEND, min(real, WINDOW))]
        return out


class DepthWindowProcessor(SeriesProcessor):
    """Rows stream_id, idx and depth from rows stream_id, idx, values and is_eof."""

    fields = "first long, window long, frames array<array<double>>, chain array<array<double>>, pending array<array<double>>"

    def __init__(self, model, signature: str = "", on_change: str = "new"):
        self.model, self.signature = model, Signature(signature, on_change)

    def part(self, states: dict[Any, tuple], columns: dict[str, np.ndarray], runs: list[Run]) -> Iterator[pd.DataFrame]:
        for stream, a, b, ended in runs:
            core = DepthWindowCore(self.model)
            state = self.held(states, stream)
            if state is not None:
                first, window, *rest = state
                core.first, core.window = first, window
                core.frames, chain, core.pending = ([np.array(x, float) for x in v] for v in rest)
                core.chain = tuple(chain) or None
            out = core.push([np.asarray(v, float) for v in columns["values"][a:b]], ended)
            lists = [[x.tolist() for x in v] for v in (core.frames, core.chain or (), core.pending)]
            self.keep(states, stream, None if ended else (core.first, core.window, *lists))
            yield pd.DataFrame({"stream_id": [stream] * len(out), "idx": np.array([i for i, _ in out], int), "depth": _fields([d for _, d in out])})


def _through(rows: DataFrame, groups: int | None, processor: SeriesProcessor, columns: str) -> DataFrame:
    out = _dealt(rows, groups).transformWithStateInPandas(processor, f"stream_id string, {columns}", "Append", "None")
    return out.withColumn("stream_id", F.col("stream_id").cast("long"))


def densify_stream(rows: DataFrame, multiplier: int, **how) -> DataFrame:
    """From rows stream_id, idx, v and is_eof, v being a number or an array of them."""
    frames = rows.schema["v"].dataType.typeName() == "array"
    kind = "array<double>" if frames else "double"
    return _through(rows, None if frames else GROUPS, DensifyProcessor(multiplier, frames=frames, **how), f"out_idx long, v {kind}")


def stability_stream(rows: DataFrame, *, groups: int | None = None, **how) -> DataFrame:
    """From rows stream_id, idx, v (an array) and is_eof. ``groups`` is for many streams of small arrays: a group's states are held at once."""
    return _through(rows, groups, StabilityProcessor(**how), "idx long, stable array<double>")


def bounds_stream(rows: DataFrame, ema: float = 0.95) -> DataFrame:
    return _through(rows, GROUPS, BoundsProcessor(ema), "idx long, norm_low double, norm_high double")


def depth_window_stream(rows: DataFrame, model, **how) -> DataFrame:
    return _through(rows, None, DepthWindowProcessor(model, **how), "idx long, depth array<double>")


#: What a query is started with. A sort within partitions is refused before a stateful step otherwise, though all of a micro-batch's
#: rows are there to be sorted; no order between micro-batches is claimed.
_START = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.unsupportedOperationCheck": "false"}


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, *, form: str = "parquet", **options: str) -> None:
    """All that the source has, in as many micro-batches as it gives, appended to ``sink``."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _START}
    try:
        for k, v in _START.items():
            spark.conf.set(k, v)
        query = stream.writeStream.format(form).options(**options).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
