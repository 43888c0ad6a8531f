import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import pixels as px
from frameloom.functions import scalars as sc
from frameloom.operators import layout, spatial, warp
from frameloom.plans import encoder, nodes
from frameloom.sources import rawframes


def picture(spark, values, extra=None):
    h, w = values.shape
    rows = [(0, y, x, float(values[y, x]), float(extra[y, x]) if extra is not None else 0.0) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "f long, y long, x long, v double, z double")


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


def splat_model(v, z, shift):
    h, w = v.shape
    num, den, front = np.zeros((h, w)), np.zeros((h, w)), np.full((h, w), -np.inf)
    taps = []
    for y in range(h):
        for x in range(w):
            t = x + shift[y, x]
            for at, weight in ((int(np.floor(t)), 1 - (t - np.floor(t))), (int(np.floor(t)) + 1, t - np.floor(t))):
                if 0 <= at < w and weight > 0:
                    taps.append((y, at, z[y, x], weight, v[y, x]))
                    front[y, at] = max(front[y, at], z[y, x])
    for y, x, zz, weight, value in taps:
        if zz >= front[y, x] - 1e-5:
            num[y, x] += weight * value
            den[y, x] += weight
    hole = den <= 1e-8
    return np.where(hole, np.nan, num / np.where(hole, 1, den)), np.where(np.isfinite(front), front, 1.0), hole


def fill_model(v, z, hole, most):
    out = np.where(hole, 0, v)
    for y, x in zip(*np.nonzero(hole), strict=True):
        left = next((k for k in range(x, -1, -1) if not hole[y, k]), None)
        right = next((k for k in range(x, v.shape[1]) if not hole[y, k]), None)
        dl, dr = (10**9 if left is None else x - left), (10**9 if right is None else right - x)
        if left is None and right is None:
            continue
        ok_l, ok_r = dl <= most, dr <= most
        if ok_l and ok_r:
            take = dl <= dr if abs(z[y, left] - z[y, right]) < 0.02 else z[y, left] < z[y, right]
        else:
            take = ok_l or (not ok_r and dl <= dr)
        out[y, x] = v[y, left] if take else v[y, right]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_splat_and_fill_equal_loops(spark, seed):
    rng = np.random.default_rng(seed)
    v, z = rng.uniform(size=(6, 16)), np.round(rng.uniform(size=(6, 16)), 2)
    z[0] = 1.0  # a row that moves out of the picture as a whole
    df = picture(spark, v, z)
    shift = (z - 0.2) * 40 * 0.5
    got = warp.splat(df, ["f"], ["v"], "z", px.disparity(F.col("z"), 0.2, 40.0) * 0.5, 16).cache()
    want, front, hole = splat_model(v, z, shift)
    assert hole[0].all()
    assert np.allclose(array(got, "v", v.shape), want, equal_nan=True)
    assert np.allclose(array(got, "z", v.shape), front)
    filled = array(warp.fill_holes(got, ["f"], ["v"], "z", max_distance=3), "v", v.shape)
    assert np.allclose(filled, fill_model(want, front, hole, 3))


def test_box_mean_and_resizes(spark):
    rng = np.random.default_rng(3)
    v = rng.uniform(size=(7, 9))
    df = picture(spark, v)
    mean = np.array([[v[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean() for x in range(9)] for y in range(7)])
    assert np.allclose(array(spatial.box_mean(df, ["f"], ["v"], 2), "v", v.shape), mean)
    for kernel in ("linear", "antialias", "cubic"):
        for to in ((11, 16), (3, 4), (7, 9)):
            relational = array(spatial.resize(df, ["f"], ["v"], v.shape, to, kernel=kernel), "v", to)
            frames = spark.createDataFrame([(0, v.reshape(-1).tolist())], "f long, v array<double>")
            dense = np.array(spatial.resize_frames(frames, "v", v.shape, to, kernel=kernel).first().v).reshape(to)
            assert np.allclose(relational, dense)
            flat = array(spatial.resize(df.withColumn("v", F.lit(0.25)), ["f"], ["v"], v.shape, to, kernel=kernel), "v", to)
            assert np.allclose(flat, 0.25)
    with pytest.raises(ValueError):
        spatial.resize(df, ["f"], ["v"], (7, 9), (3, 3), kernel="other")


def test_layouts(spark):
    v = np.arange(12.0).reshape(3, 4)
    frames = layout.to_frames(picture(spark, v), ["f"], "v")
    assert frames.first()["values"] == v.reshape(-1).tolist()
    pair = frames.withColumn("other", F.transform("values", lambda x: -x))
    sbs = np.array(layout.side_by_side_frames(pair, "values", "other", 4).first().sbs).reshape(3, 8)
    assert (sbs == np.concatenate([v, -v], axis=1)).all()
    assert layout.crop(picture(spark, v), 1, 1, 2, 2).count() == 4
    with pytest.raises(ValueError):
        layout.split_eyes(frames, 5)


def test_identities_and_renderer_names(spark):
    df = picture(spark, np.full((2, 4), 1.5), np.full((2, 4), 0.2))
    assert df.select(px.tune(F.col("v")).alias("t")).first().t == 1.5  # nothing to do: not even clamped
    one = warp.render_eye(df, ["f"], ["v"], "z", 1, (2, 4), max_eye_px=4.0, renderer="zbuffer")
    other = warp.render_eye(df, ["f"], ["v"], "z", 1, (2, 4), max_eye_px=4.0, renderer="no such name")
    assert sorted(one.collect()) == sorted(other.collect())
    assert spatial.box_mean(df, ["f"], ["v"], 0) is df
    bad = df.where("x > 0").select("f", "y", "x", F.col("z").alias("d"))
    with pytest.raises(Exception, match="differ in length"):
        warp.join_depth(df.select("f", "y", "x", "v"), bad, ["f", "y", "x"]).collect()


def test_names_and_rates(spark):
    row = spark.range(1).select(
        sc.safe_stem(F.lit("a/b: c?.tar.mp4")).alias("a"), sc.safe_stem(F.lit("")).alias("b"), sc.safe_stem(F.lit(" . ")).alias("c"), sc.rate_text(F.lit(12.5)).alias("d"), sc.rate_text(F.lit(100.0)).alias("e"), sc.rate_text(F.lit(0.0)).alias("f"),
        sc.output_name(F.lit("dir/name"), F.lit("x.mkv"), F.lit(" SBS"), F.lit(True)).alias("g"), sc.output_name(F.lit("dir/name"), F.lit("x.mkv"), F.lit(" SBS"), F.lit(False)).alias("h"), sc.parse_rate(F.lit("24000/1001")).alias("i"),
    ).first()
    assert row[:8] == ("b_ c_.tar", "video", "video", "12.5M", "100M", None, "dir/x SBS", "dir/name")
    assert row.i == pytest.approx(23.976, abs=1e-3)


def test_raw_frames(spark, tmp_path):
    spark.dataSource.register(rawframes.RawFrames)
    data = np.arange(6 * 2 * 3, dtype=np.uint8)
    path = tmp_path / "a.raw"
    path.write_bytes(data.tobytes())
    options = {"path": str(path), "width": 2, "height": 1, "frames_per_partition": 4, "total_frames": 9999}
    got = spark.read.format("rawframes").options(**options).load().orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == list(range(6)) and [r.is_last for r in got] == [False] * 5 + [True]
    assert b"".join(bytes(r.data) for r in got) == data.tobytes()
    assert spark.read.format("rawframes").options(**options, frame_load_cap=2).load().count() == 2
    back = rawframes.pack(rawframes.unpack(spark.createDataFrame(got)), "rgb", out="again").orderBy("frame_idx").collect()
    assert b"".join(bytes(r.again) for r in back) == data.tobytes()
    path.write_bytes(data.tobytes()[:-1])
    with pytest.raises(Exception, match="after the last whole frame"):
        spark.read.format("rawframes").options(**options).load().count()
    rows = spark.createDataFrame([(i, bytes([i] * 3)) for i in range(20)], "out_idx long, data binary").repartition(3)
    rawframes.write_ordered(rows, str(tmp_path / "out"), partitions=4, expected=20)
    import json

    files = json.loads((tmp_path / "out/manifest.json").read_text())["files"]
    assert b"".join((tmp_path / "out" / f).read_bytes() for f, _ in files) == bytes(k for k in range(20) for _ in range(3))
    with pytest.raises(Exception, match="instead of 21"):
        rawframes.write_ordered(rows, str(tmp_path / "bad"), partitions=2, expected=21)
    assert not list((tmp_path / "bad").glob("part-*"))


def test_streamed_frames(spark, tmp_path):
    spark.dataSource.register(rawframes.RawFrames)
    (tmp_path / "a.raw").write_bytes(bytes(range(30)))
    stream = spark.readStream.format("rawframes").options(path=str(tmp_path / "a.raw"), width=1, height=1, frames_per_batch=4).load()
    query = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert sorted(r.frame_idx for r in spark.table("frames").collect()) == list(range(10))
    finally:
        query.stop()


def test_probe(spark):
    text = '{"streams":[{"width":4,"height":2,"avg_frame_rate":"0/0","r_frame_rate":"25/1","pix_fmt":"YUV420P10LE","codec_name":"HEVC"}],"format":{"duration":"2.02"}}'
    row = spark.range(1).select(rawframes.probe(F.lit(text)).alias("p")).first().p
    assert (row.width, row.fps, row.total_frames, row.ten_bit, row.codec_name, row.color_space) == (4, 25.0, 50, True, "hevc", "unknown")


@pytest.mark.parametrize(("change", "ok"), [({}, True), ({"crf": 52}, False), ({"codec": "av1", "crf": 63}, True), ({"codec": "av1", "rate_control": "cqp"}, False), ({"codec": "av1", "rate_control": "lossless"}, False), ({"codec": "av1_vaapi", "rate_control": "cqp", "av1_qp": 0}, False), ({"codec": "av1_vaapi", "rate_control": "cqp", "av1_qp": 255}, True), ({"rate_control": "vbr", "maxrate_mbps": 99}, False), ({"rate_control": "vbr"}, True), ({"bit_depth": "12bit"}, False)])
def test_encoder_settings(change, ok):
    s = encoder.with_settings(encoder.Settings(), **change)
    assert (encoder.problem(s) is None) == ok
    if not ok:
        with pytest.raises(ValueError):
            encoder.command("ffmpeg", 24, 8, 4, "o.mp4", s)


def test_encoder_commands():
    make = lambda **c: encoder.command("ffmpeg", 120, 3840, 2160, "o.mp4", encoder.with_settings(encoder.Settings(), **c))
    vbr = make(codec="av1_vaapi", rate_control="vbr")
    assert vbr[vbr.index("-rc_mode") + 1] == "VBR" and vbr[vbr.index("-b:v") + 1] == "100M" and vbr[vbr.index("-maxrate") + 1] == "135M"
    assert "rgb48le" in vbr and any(a.endswith("format=p010le,hwupload") for a in vbr)
    cqp = make(codec="av1_vaapi", rate_control="cqp", av1_qp=60, bit_depth="8bit")
    assert cqp[cqp.index("-global_quality") + 1] == "60" and "rgb24" in cqp
    av1 = make(codec="av1", rate_control="vbr")
    assert "-maxrate" not in av1 and av1[av1.index("-preset") + 1] == "8"
    assert make(codec="x265", rate_control="lossless")[-12 - 4 :].count("lossless=1") == 1
    assert "-qp" in encoder.legacy_command("ffmpeg", 24, 8, 4, "o.mp4", "lossless_x264_qp0")
    with pytest.raises(ValueError):
        encoder.legacy_command("ffmpeg", 24, 8, 4, "o.mp4", "other")


def test_nodes():
    assert len(nodes.REGISTRY) == 18
    with pytest.raises(ValueError):
        nodes.register("SBSCombine", print)
    assert [k for k, _ in nodes.stage_profile({"z": 1, "block1": 2, "a": 3, "encode": 4}, ["encode", "block0", "block1"])] == ["encode", "block1", "a", "z"]


def test_rates_have_six_digits(spark):
    values = [12.5, 100.0, 123.4567, 0.00001, 0.0001234567, 999999.5, 1e6, 99999.97, 0.1, 7.0, 1234567.0, 150.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(sc.rate_text(F.col("v")).alias("t")).collect()] == [f"{v:g}M" for v in values]


def test_names_of_outputs_that_are_taken(spark):
    df = spark.createDataFrame([("a", []), ("a", ["a.mp4"]), ("a", ["a.mp4", "a (2).mp4", "a (4).mp4"]), ("b c", ["a.mp4"])], "stem string, taken array<string>")
    assert [r.n for r in df.select(sc.free_output(F.col("stem"), F.col("taken")).alias("n")).collect()] == ["a", "a (2)", "a (3)", "b c"]


def test_decode_chain(spark):
    pixels = spark.createDataFrame([(f, y, x, float(100 * f + 10 * y + x)) for f in range(4) for y in range(4) for x in range(8)], "f long, y long, x long, v double")
    same, size = layout.decode_chain(pixels, [], "f", ["v"], (4, 8))
    assert size == (4, 8) and same.count() == pixels.count()
    fast, _ = layout.decode_chain(pixels, [], "f", ["v"], (4, 8), rate=24, force_rate=48)
    assert sorted({(r.f, int(r.v // 100)) for r in fast.collect()}) == [(k, k // 2) for k in range(8)]
    slow, _ = layout.decode_chain(pixels, [], "f", ["v"], (4, 8), rate=24, force_rate=12, cap=1)
    assert {(r.f, int(r.v // 100)) for r in slow.collect()} == {(0, 0)}
    square, size = layout.decode_chain(pixels, [], "f", ["v"], (4, 8), to=(4, 4))
    got = {(r.f, r.y, r.x): r.v for r in square.collect()}
    assert size == (4, 4) and all(v == 100 * f + 10 * y + x + 2 for (f, y, x), v in got.items())
    half, size = layout.decode_chain(pixels, [], "f", ["v"], (4, 8), to=(0, 4))
    assert size == (2, 4) and half.where("f = 0").count() == 8


def test_depth_of_another_size(spark):
    rgb = spark.createDataFrame([(0, y, x, 0.5, 0.25 * y) for y in range(4) for x in range(4)], "f long, y long, x long, r double, g double")
    depth = spark.createDataFrame([(0, y, x, 0.2 + 0.5 * y + 0.1 * x) for y in range(2) for x in range(2)], "f long, y long, x long, z double")
    big = {(r.y, r.x): r.z for r in warp.upsample_depth(depth, ["f"], "z", (2, 2), (4, 4)).collect()}
    line = [0, 0.25, 0.75, 1]
    assert all(big[y, x] == pytest.approx(min(1, 0.2 + 0.5 * line[y] + 0.1 * line[x])) for y in range(4) for x in range(4))
    left, right = warp.render_with_depth(rgb, depth, ["f"], ["r", "g"], "z", (4, 4), (2, 2), max_eye_px=1.0)
    assert left.count() == right.count() == 16


def test_a_stream_of_frames_and_its_end(spark, tmp_path):
    spark.dataSource.register(rawframes.RawFrames)
    (tmp_path / "in").mkdir()
    rows = [(k, bytes([k] * 6)) for k in range(7)]
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, "out_idx long, data binary").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    def go(out, **options):
        stream = spark.readStream.schema("out_idx long, data binary").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in/*")
        query = stream.writeStream.format("rawframes").options(path=str(tmp_path / out), **options).option("checkpointLocation", str(tmp_path / f"{out}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    go("a", expected_frames="7")
    assert rawframes.finish(str(tmp_path / "a"), 7) == 7
    with pytest.raises(rawframes.SourceError):
        rawframes.finish(str(tmp_path / "a"), 8)
    read = spark.read.format("rawframes").options(path=str(tmp_path / "a"), width=2, height=1, frames_per_partition=2).load().orderBy("frame_idx").collect()
    assert [(r.frame_idx, bytes(r.data), r.is_last) for r in read] == [(k, d, k == 6) for k, d in rows]
    with pytest.raises(Exception, match="instead of 4"):
        go("b", expected_frames="4")
    with pytest.raises(Exception, match="force_rate"):
        spark.read.format("rawframes").options(path=str(tmp_path / "a"), width=2, height=1, force_rate=24).load().count()
