"""Streams' processors without Spark's engine where that will do: parts of groups of streams, as Spark hands them over."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.plans import catalogue
from frameloom.streaming import series


class Held:
    """A list state as a processor sees it."""

    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        assert rows
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def walked(processor, batches, part):
    """What a group gives over micro-batches of rows (stream, idx, is_eof, columns), each sorted and handed over in parts."""
    processor.state, out = Held(), []
    for batch in batches:
        given = pd.DataFrame(batch).sort_values(["stream_id", "is_eof", "idx"], kind="stable", na_position="first")
        parts = (given.iloc[at : at + part] for at in range(0, len(given), part))
        out += list(processor.handleInputRows(("group",), parts, None))
    return pd.concat(out), processor.state.rows


def stream_rows(lengths, cuts, columns):
    """Micro-batches cut at indices, ends in the last; some streams have nothing but their end there."""
    batches = [[] for _ in range(len(cuts) + 1)]
    for stream, n in lengths.items():
        for i in range(n):
            batches[int(np.searchsorted(cuts, i, side="right"))].append({"stream_id": stream, "idx": i, "is_eof": False, **columns(stream, i)})
        batches[-1].append({"stream_id": stream, "idx": n, "is_eof": True, **dict.fromkeys(columns(stream, 0))})
    return batches


LENGTHS = {"1": 9, "2": 3, "3": 2, "4": 31, "5": 12, "6": 1}
VALUE = {s: np.random.default_rng(int(s)).normal(0, 30, n) for s, n in LENGTHS.items()}


@pytest.mark.parametrize("part", [1, 4, 1000])
@pytest.mark.parametrize(("threshold", "tail", "m"), [(0.0, True, 4), (30.0, False, 3), (0.0, True, 1)])
def test_densified_groups_equal_a_loop(part, threshold, tail, m):
    got, left = walked(series.DensifyProcessor(m, threshold, tail), stream_rows(LENGTHS, [5, 10], lambda s, i: {"v": VALUE[s][i]}), part)
    want = {}
    for s, v in VALUE.items():
        made = []
        for a, b in zip(v, v[1:]):
            made += [a] + [a if threshold and abs(b - a) >= threshold else a * (1 - j / m) + b * (j / m) for j in range(1, m)]
        want |= {(s, i): x for i, x in enumerate([*made, *[v[-1]] * (m if tail else 1)])}
    assert len(got) == len(want) and dict(zip(zip(got["stream_id"], got["out_idx"]), got["v"])) == want
    assert not left


@pytest.mark.parametrize("part", [1, 4, 1000])
def test_bounds_and_stability_of_groups_equal_a_loop(part):
    cut = lambda s, i: i > 0 and abs(VALUE[s][i] - VALUE[s][i - 1]) >= 40
    got, left = walked(series.BoundsProcessor(0.9), stream_rows(LENGTHS, [5, 10], lambda s, i: {"low": VALUE[s][i], "high": VALUE[s][i] + 10, "cut": cut(s, i)}), part)
    fields, rest = walked(series.StabilityProcessor(0.5, 20.0), stream_rows(LENGTHS, [5, 10], lambda s, i: {"v": np.array([VALUE[s][i]])}), part)
    low, stable = {}, {}
    for s, v in VALUE.items():
        held = before = None
        for i, x in enumerate(v):
            held = low[s, i] = x if held is None or cut(s, i) else 0.9 * held + (1 - 0.9) * x
            before = stable[s, i] = x + 0.5 * (before - x) if before is not None and abs(x - before) < 20 else x
    assert dict(zip(zip(got["stream_id"], got["idx"]), got["norm_low"])) == low and len(got) == len(low)
    assert {(s, i): x[0] for s, i, x in zip(fields["stream_id"], fields["idx"], fields["stable"])} == stable
    assert not left and not rest


def test_settings_change_for_the_streams_that_go_on():
    rows = stream_rows({"1": 4, "2": 2}, [2], lambda s, i: {"v": float(i)})
    first = series.DensifyProcessor(2)
    first.state = Held()
    list(first.handleInputRows(("g",), iter([pd.DataFrame(rows[0]).sort_values(["stream_id", "idx"])]), None))
    for how in ("error", "new"):
        then = series.DensifyProcessor(4, on_change=how)
        then.state = Held()
        then.state.rows = list(first.state.rows)
        goes_on = pd.DataFrame([r for r in rows[1] if r["stream_id"] == "1" and not r["is_eof"]])
        if how == "error":
            with pytest.raises(ValueError, match="settings changed"):
                list(then.handleInputRows(("g",), iter([goes_on]), None))
        else:
            assert len(pd.concat(list(then.handleInputRows(("g",), iter([goes_on]), None)))) == 5  # 2, three steps, 3
            assert {r[0] for r in then.state.rows} == {"1", "2"}


def test_rows_out_of_order_are_an_error():
    rows = [{"stream_id": "1", "idx": i, "is_eof": False, "v": 0.0} for i in (0, 2, 1)]
    for parts in ([rows], [rows[:2], rows[2:]]):
        p = series.DensifyProcessor(2)
        p.state = Held()
        with pytest.raises(ValueError, match="not in order"):
            list(p.handleInputRows(("g",), iter([pd.DataFrame(x) for x in parts]), None))


def test_windows_hold_a_part_and_not_the_micro_batch():
    """A long stream in one micro-batch: what has been handed on is let go, so a part's frames and the open windows are what stays."""
    import tracemalloc

    def peak(n):
        p = series.DepthWindowProcessor(lambda w: w + 1)
        p.state = Held()
        parts = (pd.DataFrame({"stream_id": "0", "idx": range(at, at + 500), "is_eof": False, "values": [np.full(256, i / n) for i in range(500)]}) for at in range(0, n, 500))
        tracemalloc.start()
        seen = sum(len(out) for out in p.handleInputRows(("0",), parts, None))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen > n - 40
        return most

    assert peak(10_000) < 1.5 * peak(2_000)


def test_a_group_of_streams_is_one_call(spark):
    """Streams share calls, state and order: fewer groups than streams."""
    rows = spark.range(3000).selectExpr("id % 1000 AS stream_id", "id AS idx", "false AS is_eof")
    keyed = series._dealt(rows, series.GROUPS)._df
    assert keyed.select("_group").distinct().count() <= series.GROUPS
    assert keyed.groupBy("stream_id").agg(F.count_distinct("_group").alias("n")).where("n > 1").count() == 0


def test_a_micro_batch_is_written_by_more_than_one_task(spark, tmp_path, monkeypatch):
    """A folder of files each; a single file is a single task's work, which grows with the input."""
    monkeypatch.setattr(catalogue, "shared_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    rows = spark.range(0, 4000, numPartitions=4).select((F.col("id") % 40).alias("stream_id"), F.floor(F.col("id") / 40).alias("idx"), F.lit(1.0).alias("v"))
    stream = catalogue._streamed(spark, rows, 30, ["v"])
    files = spark.sparkContext.defaultParallelism
    assert files > 1 and [len(list(tmp_path.glob(f"stream/in/{k}/part-*.parquet"))) for k in range(3)] == [files] * 3
    found = [spark.read.parquet(f"{tmp_path}/stream/in/{k}").where("idx IS NOT NULL") for k in range(3)]
    assert [f.where("NOT is_eof").count() for f in found] == [1200, 1200, 1600]
    assert [f.where("is_eof").count() for f in found] == [0, 0, 40] and found[2].where("is_eof").agg(F.min("idx"), F.max("idx")).first() == (100, 100)
    sizes = []
    query = stream.writeStream.foreachBatch(lambda df, k: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sizes == [1200, 1200, 1640]
