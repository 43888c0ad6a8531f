"""Registered queries and their SQL. Stand-ins: ``embeddings`` are 8 x 8 frames (vec_id is the frame),
``events`` a series per user in the order of ts and event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import scalars as sc
from ..operators import layout, spatial, temporal, warp
from ..session import shared_folder, table
from ..sources import rawframes
from ..streaming import series
from . import encoder

SIDE = 8
KEYS = ["frame_idx"]
q = px.quantised


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), values.alias("e"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, y, x, v and the depth z: v moved into 0..1."""
    return layout.to_pixels(_frames(spark, sf_dir), KEYS, "e", SIDE).withColumn("z", px.clamp01(F.col("v") + 0.5))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, idx from 0, v and the next and previous v."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"))
    return e.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "v", F.lead("v").over(w).alias("next_v"), F.lag("v").over(w).alias("prev_v"))


_CELLS = """c AS (SELECT frame_idx, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, e[i + 1]::DOUBLE AS v, greatest(0e0, least(1e0, e[i + 1]::DOUBLE + 0.5e0)) AS z
    FROM (SELECT vec_id AS frame_idx, embedding AS e, unnest(generate_series(0, 63)) AS i FROM embeddings))"""
_EVENTS = """s AS (SELECT user_id, (row_number() OVER w - 1)::BIGINT AS idx, value AS v, lead(value) OVER w AS next_v, lag(value) OVER w AS prev_v
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _q(x: str, scale: str = "1e6") -> str:
    return f"floor(({x}) * {scale} + 0.5e0)::BIGINT"


_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- per-pixel arithmetic and scalars


@_query(f"""WITH t AS (SELECT vec_id AS frame_idx, k::INTEGER AS k, embedding[3 * k % 64 + 1]::DOUBLE AS r, embedding[(3 * k + 1) % 64 + 1]::DOUBLE AS g, embedding[(3 * k + 2) % 64 + 1]::DOUBLE AS b
    FROM (SELECT vec_id, embedding, unnest(generate_series(0, 21)) AS k FROM embeddings))
    SELECT frame_idx, k, {_q('greatest(0e0, least(1e0, r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0))')} AS luma FROM t""")
def q_luma_clamp(spark, sf_dir):
    t = _frames(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(21))))
    r, g, b = (F.get("e", (3 * F.col("k") + c) % 64) for c in range(3))
    return t.select("frame_idx", "k", q(px.clamp01(px.luma(r, g, b))).alias("luma"))


@_query(f"""WITH {_CELLS} SELECT frame_idx, y, x, {_q('(z - 0.25e0) * 26.88e0')} AS disparity, {_q('pow(z, 1.5e0)')} AS gamma, {_q('1 - z')} AS inverted, {_q('(z - 0.485e0) / 0.229e0')} AS normal FROM c""")
def q_disparity_gamma(spark, sf_dir):
    z = F.col("z")
    return _cells(spark, sf_dir).select("frame_idx", "y", "x", q(px.disparity(z, 0.25, 26.88)).alias("disparity"), q(px.gamma(z, 1.5)).alias("gamma"), q(px.invert(z)).alias("inverted"), q(px.channel_normalise(z, 0)).alias("normal"))


@_query("""WITH t AS (SELECT p_partkey, (p_size * 37 + 640)::BIGINT AS w FROM part),
    e AS (SELECT *, w // 2 AS eye, (w // 2) * 1.5e-2 AS p FROM t)
    SELECT p_partkey, eye AS eye_width, floor(p * 1e6 + 0.5e0)::BIGINT AS disparity, floor(p / 2 * 1e6 + 0.5e0)::BIGINT AS rendered, greatest(1, round_even(p * 3e0, 0)::BIGINT) AS fill FROM e""")
def q_disparity_controls(spark, sf_dir):
    c = sc.stereo_controls((F.col("p_size") * 37 + 640).cast("long"), half=True, strength_percent=1.5)
    t = table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))
    return t.select("p_partkey", "c.eye_width", q(F.col("c.max_disparity_eye_px")).alias("disparity"), q(F.col("c.rendered_eye_px")).alias("rendered"), F.col("c.max_fill_distance").alias("fill"))


_TARGETS = (24.0, 30.0, 60.0, 119.88, 120.0, 120.006)


@_query("""WITH t AS (SELECT p_partkey, (p_size * 0.999e0)::DOUBLE AS src, unnest([24e0, 30e0, 60e0, 119.88e0, 120e0, 120.006e0]) AS tgt FROM part),
    d AS (SELECT *, abs(src - tgt) <= greatest(0.25e0, abs(tgt) * 0.005e0) AS near, round_even(tgt / src, 0)::INTEGER AS m FROM t)
    SELECT p_partkey, tgt, CASE WHEN near THEN 1 WHEN tgt <= src OR m < 2 OR m > 16 THEN NULL ELSE m END AS multiplier,
           CASE WHEN near THEN src WHEN tgt <= src OR m < 2 OR m > 16 THEN NULL ELSE src * m END AS fps,
           CASE WHEN near THEN NULL WHEN tgt <= src THEN 'above target' WHEN m < 2 OR m > 16 THEN 'multiplier' END AS problem FROM d""")
def q_cadence(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.lit(0.999)).alias("src"), F.explode(F.array(*map(F.lit, _TARGETS))).alias("tgt"))
    return t.withColumn("c", sc.cadence(F.col("src"), F.col("tgt"))).select("p_partkey", "tgt", "c.multiplier", "c.fps", "c.problem")


@_query("""WITH t AS (SELECT p_partkey, p_size AS n, p_partkey % 4 + 1 AS m, p_partkey % 2 = 0 AS prior, p_partkey % 3 = 0 AS final FROM part)
    SELECT p_partkey, ((CASE WHEN prior THEN n * m ELSE (n - 1) * m + 1 END) + CASE WHEN final THEN m - 1 ELSE 0 END)::BIGINT AS planned FROM t""")
def q_planned_frames(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", sc.planned_frames(F.col("p_size"), k % 4 + 1, k % 2 == 0, k % 3 == 0).alias("planned"))


@_query("""WITH t AS (SELECT p_partkey, (p_size * 13 + 200)::DOUBLE AS h, (p_partkey % 17 * 100 + 300)::DOUBLE AS w FROM part),
    r AS (SELECT *, greatest(h, w) / greatest(1e0, least(h, w)) AS ratio FROM t),
    b AS (SELECT *, CASE WHEN ratio > 1.78e0 THEN greatest(14e0, round_even(floor(518e0 * 1.777e0 / ratio) / 14, 0) * 14) ELSE 518e0 END AS base FROM r),
    s AS (SELECT *, greatest(base / h, base / w) AS scale FROM b)
    SELECT p_partkey, greatest(base, round_even(h * scale / 14, 0) * 14)::INTEGER AS in_h, greatest(base, round_even(w * scale / 14, 0) * 14)::INTEGER AS in_w FROM s""")
def q_model_input_size(spark, sf_dir):
    size = sc.model_input_size((F.col("p_size") * 13 + 200).cast("double"), (F.col("p_partkey") % 17 * 100 + 300).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", F.col("s.h").alias("in_h"), F.col("s.w").alias("in_w"))


@_query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '24000/1001' WHEN 1 THEN '0/0' WHEN 2 THEN 'N/A' WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN p_size || '/' || (p_partkey % 7) ELSE '' END AS r FROM part),
    s AS (SELECT *, string_split(r, '/') AS p FROM t)
    SELECT p_partkey, coalesce(CASE WHEN len(p) = 2 AND try_cast(p[2] AS DOUBLE) <> 0 THEN try_cast(p[1] AS DOUBLE) / try_cast(p[2] AS DOUBLE) WHEN len(p) = 1 THEN try_cast(p[1] AS DOUBLE) END, 0e0) AS rate FROM s""")
def q_parse_rate(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 6 == 0, "24000/1001").when(k % 6 == 1, "0/0").when(k % 6 == 2, "N/A").when(k % 6 == 3, n.cast("string")).when(k % 6 == 4, F.concat_ws("/", n, k % 7)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", sc.parse_rate(text).alias("rate"))


@_query("""SELECT p_partkey, printf('%g', p_retailprice / 7e0) || 'M' AS rate, printf('%g', p_size / 3e6) || 'M' AS low FROM part""")
def q_rate_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.rate_text(F.col("p_retailprice") / 7).alias("rate"), sc.rate_text(F.col("p_size") / 3e6).alias("low"))


@_query(f"""WITH t AS (SELECT p_partkey, (p_size * 16)::INTEGER AS width, p_partkey % 3 AS k, 1000e0 * (p_size + 1) / 1001 AS rate, p_retailprice AS seconds, p_partkey % 5 = 0 AS deep FROM part)
    SELECT p_partkey, width, {_q('CASE WHEN k = 2 THEN 1 ELSE rate END')} AS fps, CASE WHEN k = 0 THEN p_partkey + 1 ELSE round_even(seconds * CASE WHEN k = 2 THEN 1 ELSE rate END, 0)::BIGINT END AS total_frames,
    CASE WHEN deep THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt, deep AS ten_bit, CASE WHEN deep THEN 6 ELSE 3 END AS bytes FROM t""")
def q_probe(spark, sf_dir):
    """A probe's JSON: counted frames, frames from the duration, and an unknown rate, which is 1."""
    k, deep = F.col("p_partkey") % 3, F.col("p_partkey") % 5 == 0
    rate = F.when(k == 2, "0/0").otherwise(F.concat((F.col("p_size") + 1) * 1000, F.lit("/1001")))
    stream = F.struct((F.col("p_size") * 16).alias("width"), rate.alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"), F.when(k == 0, (F.col("p_partkey") + 1).cast("string")).otherwise("N/A").alias("nb_frames"), F.when(deep, "YUV420P10LE").otherwise("yuv420p").alias("pix_fmt"))
    text = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(F.col("p_retailprice").cast("string").alias("duration")).alias("format")))
    p = table(spark, sf_dir, "part").select("p_partkey", rawframes.probe(text).alias("p"))
    return p.select("p_partkey", "p.width", q(F.col("p.fps")).alias("fps"), "p.total_frames", "p.pix_fmt", "p.ten_bit", rawframes.raw_format(F.col("p.ten_bit"))["bytes"].alias("bytes"))


@_query("""WITH c(codec, k, encoder, label, f8, f10) AS (VALUES ('x264', 0, 'libx264', 'video/h264-mp4', 'yuv420p', 'yuv420p10le'), ('x265', 1, 'libx265', 'video/h265-mp4', 'yuv420p', 'yuv420p10le'), ('av1', 2, 'libsvtav1', 'video/av1-mp4', 'yuv420p', 'yuv420p10le'), ('av1_vaapi', 3, 'av1_vaapi', 'video/av1-mp4', 'nv12', 'p010le'))
    SELECT p_partkey, codec, encoder, label, CASE WHEN p_size % 2 = 0 THEN f8 ELSE f10 END AS pix_fmt FROM part JOIN c ON c.k = p_partkey % 4""")
def q_codec_lookup(spark, sf_dir):
    """Options looked up in the table of codecs."""
    codec = F.get(F.array(*map(F.lit, encoder.CODECS)), (F.col("p_partkey") % 4).cast("int"))
    asked = table(spark, sf_dir, "part").select("p_partkey", codec.alias("codec"), F.when(F.col("p_size") % 2 == 0, "8bit").otherwise("10bit").alias("bit_depth"))
    return asked.join(encoder.codecs(spark), ["codec", "bit_depth"]).select("p_partkey", "codec", "encoder", "label", "pix_fmt")


@_query(f"WITH {_CELLS} SELECT frame_idx, y, x, {_q('v')} AS untouched, {_q('greatest(0e0, least(1e0, 0.5e0 + (v - 0.5e0) * 1.5e0))')} AS scaled FROM c")
def q_tune_noop(spark, sf_dir):
    """Without settings depth isn't touched, not even clamped."""
    c = _cells(spark, sf_dir)
    return c.select("frame_idx", "y", "x", q(px.tune(F.col("v"))).alias("untouched"), q(px.tune(F.col("v"), zero_parallax=0.5, scale=1.5)).alias("scaled"))


@_query("""SELECT p_partkey, 'part ' || p_size AS stem, CASE WHEN p_size % 4 = 0 THEN 'part ' || p_size WHEN p_size % 4 = 1 THEN 'part ' || p_size || ' (2)' ELSE 'part ' || p_size || ' (' || (p_size % 4 + 1) || ')' END AS name FROM part""")
def q_output_collisions(spark, sf_dir):
    """Outputs are numbered from 2 where their name is taken: here by p_size % 4 earlier ones."""
    stem = F.concat(F.lit("part "), F.col("p_size"))
    taken = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == 0, F.concat(stem, F.lit(".mp4"))).otherwise(F.concat(stem, F.lit(" ("), k + 1, F.lit(").mp4"))))
    return table(spark, sf_dir, "part").select("p_partkey", stem.alias("stem"), sc.free_output(stem, F.slice(taken, 1, F.col("p_size") % 4)).alias("name"))


@_query("""WITH t AS (SELECT p_partkey, 'in/' || p_name || '?: ' || p_partkey || '.tar.mp4' AS n FROM part)
    SELECT p_partkey, 'out/' || trim(regexp_replace(regexp_replace(regexp_extract(n, '([^/]*)$', 1), '\\.[^.]*$', ''), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .') || ' Half-SBS' AS name FROM t""")
def q_output_names(spark, sf_dir):
    source = F.concat(F.lit("in/"), "p_name", F.lit("?: "), "p_partkey", F.lit(".tar.mp4"))
    return table(spark, sf_dir, "part").select("p_partkey", sc.output_name(F.lit("out/"), source, F.lit(" Half-SBS"), F.lit(True)).alias("name"))


@_query("""WITH t AS (SELECT p_size, 'clip_' || lpad(p_partkey::VARCHAR, 5, '0') || CASE WHEN p_partkey % 3 = 0 THEN '-audio' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '.mkv' ELSE '.mp4' END AS f FROM part)
    SELECT p_size, coalesce(max(try_cast(regexp_extract(f, '^clip_(\\d+)\\D*\\.mp4$', 1) AS BIGINT)), 0) + 1 AS next_counter FROM t GROUP BY p_size""")
def q_output_counter(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("clip_"), F.lpad(k.cast("string"), 5, "0"), F.when(k % 3 == 0, "-audio").otherwise(""), F.when(k % 5 == 0, ".mkv").otherwise(".mp4"))
    return table(spark, sf_dir, "part").groupBy("p_size").agg((F.coalesce(F.max(sc.frame_counter(name, "clip")), F.lit(0)) + 1).alias("next_counter"))


@_query("""WITH t AS (SELECT p_size, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' v4.26' WHEN p_partkey % 11 = 0 THEN ' v425' ELSE '' END AS m FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN regexp_matches(m, '4\\.?25') THEN 0 WHEN regexp_matches(m, '4\\.?26') THEN 1 ELSE 2 END, lower(m), m) AS k FROM t)
    SELECT p_size, m AS model FROM r WHERE k = 1""")
def q_model_rank(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 7 == 0, " v4.26").when(k % 11 == 0, " v425").otherwise(""))
    t = table(spark, sf_dir, "part").select("p_size", name.alias("m"))
    return t.groupBy("p_size").agg(F.min(F.struct(sc.model_rank(F.col("m")).alias("r"), "m")).alias("b")).select("p_size", F.col("b.m").alias("model"))


@_query(f"""WITH {_CELLS}, a AS (SELECT *, 0.5e0 + (z - 0.5e0) * 1.2e0 AS s FROM c),
    b AS (SELECT *, CASE WHEN s > 0.5e0 THEN 0.5e0 + (s - 0.5e0) * (1 - 0.3e0 * greatest(0e0, least(1e0, (s - 0.5e0) / 0.5e0))) ELSE s END AS n FROM a),
    d AS (SELECT *, CASE WHEN n < 0.5e0 THEN 0.5e0 - (0.5e0 - n) * (1 - 0.2e0 * greatest(0e0, least(1e0, (0.5e0 - n) / 0.5e0))) ELSE n END AS f FROM b)
    SELECT frame_idx, y, x, {_q('greatest(0e0, least(1e0, f))')} AS tuned FROM d""")
def q_range_compress(spark, sf_dir):
    tuned = px.tune(F.col("z"), zero_parallax=0.5, scale=1.2, near=0.3, far=0.2)
    return _cells(spark, sf_dir).select("frame_idx", "y", "x", q(tuned).alias("tuned"))


@_query(f"""WITH {_CELLS} SELECT frame_idx, y, x, floor(z * 255 + 0.5e0)::INTEGER AS u8, floor(z * 65535 + 0.5e0)::INTEGER AS u16 FROM c""")
def q_quantise_8_16bit(spark, sf_dir):
    return _cells(spark, sf_dir).select("frame_idx", "y", "x", px.to_8bit(F.col("z")).alias("u8"), px.to_16bit(F.col("z")).alias("u16"))


@_query(f"""WITH {_CELLS} SELECT frame_idx, count(*) AS n, {_q('sum(3 * z)', '1e4')} AS total FROM c GROUP BY frame_idx""")
def q_depth_preview(spark, sf_dir):
    grey = _cells(spark, sf_dir).select("frame_idx", px.preview(F.col("z")).alias("p"))
    return grey.groupBy("frame_idx").agg(F.count("*").alias("n"), q(F.sum(F.aggregate("p", F.lit(0.0), lambda a, b: a + b)), 1e4).alias("total"))


# --- neighbourhoods


def _box(inner: str, columns: str, r: int, name: str) -> str:
    cols = columns.split()
    w = "ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING".format(r)
    rest = f"* REPLACE ({', '.join(f'avg({c}) OVER w AS {c}' for c in cols)})"
    return f"{name}_x AS (SELECT {rest} FROM {inner} WINDOW w AS (PARTITION BY frame_idx, y ORDER BY x {w})), {name} AS (SELECT {rest} FROM {name}_x WINDOW w AS (PARTITION BY frame_idx, x ORDER BY y {w}))"


@_query(f"WITH {_CELLS}, {_box('c', 'v', 1, 'm')} SELECT frame_idx, y, x, {_q('v')} AS mean FROM m")
def q_box_mean(spark, sf_dir):
    return spatial.box_mean(_cells(spark, sf_dir), KEYS, ["v"], 1).select("frame_idx", "y", "x", q(F.col("v")).alias("mean"))


@_query(f"""WITH {_CELLS}, g AS (SELECT *, greatest(0e0, least(1e0, v + 0.4e0)) AS g FROM c), i AS (SELECT *, g AS a1, z AS a2, g * g AS a3, g * z AS a4 FROM g),
    {_box('i', 'a1 a2 a3 a4', 2, 'm')}, k AS (SELECT *, (a4 - a1 * a2) / (greatest(0e0, a3 - a1 * a1) + 1.0009999999999998e-3) AS k1 FROM m), b AS (SELECT *, a2 - k1 * a1 AS k2 FROM k),
    {_box('b', 'k1 k2', 2, 'n')} SELECT frame_idx, y, x, {_q('greatest(0e0, least(1e0, z + 0.5e0 * (k1 * g + k2 - z)))', '1e5')} AS smoothed FROM n""")
def q_guided_filter(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("g", px.clamp01(F.col("v") + 0.4))
    return spatial.guided_filter(c, KEYS, "g", "z", strength=0.5, radius=2, edge_protection=0.8).select("frame_idx", "y", "x", q(F.col("smoothed"), 1e5).alias("smoothed"))


_GRADIENT = "greatest(coalesce(abs({0} - lag({0}) OVER (PARTITION BY frame_idx, y ORDER BY x)), 0e0), coalesce(abs({0} - lag({0}) OVER (PARTITION BY frame_idx, x ORDER BY y)), 0e0))"


@_query(f"WITH {_CELLS}, g AS (SELECT *, {_GRADIENT.format('z')} AS e FROM c) SELECT frame_idx, y, x, {_q('e')} AS edge FROM g")
def q_gradient(spark, sf_dir):
    return spatial.gradient(_cells(spark, sf_dir), KEYS, "z", out="e").select("frame_idx", "y", "x", q(F.col("e")).alias("edge"))


@_query(f"""WITH {_CELLS}, m AS (SELECT frame_idx, y, x, max(v) OVER (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM c)
    SELECT frame_idx, y, x, {_q('max(v) OVER (PARTITION BY frame_idx, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS widest FROM m""")
def q_dilate(spark, sf_dir):
    return spatial.dilate(_cells(spark, sf_dir), KEYS, ["v"], 1).select("frame_idx", "y", "x", q(F.col("v")).alias("widest"))


@_query(f"""WITH {_CELLS}, e AS (SELECT *, {_GRADIENT.format('z')} AS e FROM c), k AS (SELECT *, greatest(0e0, least(1e0, (e - 0.04e0) / 0.04e0)) AS m, z AS soft FROM e),
    d1 AS (SELECT * REPLACE (max(m) OVER (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m) FROM k),
    d2 AS (SELECT * REPLACE (max(m) OVER (PARTITION BY frame_idx, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m) FROM d1),
    gg AS (SELECT *, {_GRADIENT.format('v')} AS ge FROM d2), w AS (SELECT * REPLACE (m * (0.5e0 + 0.5e0 * greatest(0e0, least(1e0, ge / 0.08e0))) AS m) FROM gg),
    {_box('w', 'soft', 1, 's')} SELECT frame_idx, y, x, {_q('greatest(0e0, least(1e0, z + m * 0.5e0 * (soft - z)))', '1e5')} AS feathered FROM s""")
def q_feather(spark, sf_dir):
    out = spatial.feather(_cells(spark, sf_dir), KEYS, "z", strength=0.5, radius=1, threshold=0.04, guide="v", guidance=0.5)
    return out.select("frame_idx", "y", "x", q(F.col("feathered"), 1e5).alias("feathered"))


@_query(f"WITH {_CELLS} SELECT frame_idx, y // 2 AS y, x // 2 AS x, {_q('avg(v)')} AS mean FROM c GROUP BY frame_idx, y // 2, x // 2")
def q_area_proxy(spark, sf_dir):
    return spatial.area_average(_cells(spark, sf_dir), KEYS, ["v"], (SIDE, SIDE), (4, 4)).select("frame_idx", "y", "x", q(F.col("v")).alias("mean"))


@_query(f"""WITH {_CELLS}, a AS (SELECT frame_idx, ty::BIGINT AS y, tx::BIGINT AS x, v FROM c, (SELECT unnest(generate_series(0, 2)) AS ty), (SELECT unnest(generate_series(0, 2)) AS tx)
    WHERE y >= ty * 8 // 3 AND y < ceil((ty + 1) * 8 / 3e0) AND x >= tx * 8 // 3 AND x < ceil((tx + 1) * 8 / 3e0))
    SELECT frame_idx, y, x, {_q('avg(v)')} AS mean FROM a GROUP BY frame_idx, y, x""")
def q_area_overlapping(spark, sf_dir):
    return spatial.area_average(_cells(spark, sf_dir), KEYS, ["v"], (SIDE, SIDE), (3, 3)).select("frame_idx", "y", "x", q(F.col("v")).alias("mean"))


@_query(f"""WITH {_CELLS}, t AS (SELECT t, greatest(0e0, (t + 0.5e0) * 8 / 12e0 - 0.5e0) AS p FROM (SELECT unnest(generate_series(0, 11)) AS t)),
    w AS (SELECT t, floor(p)::BIGINT AS a, least(7, floor(p) + 1)::BIGINT AS b, p - floor(p) AS f FROM t)
    SELECT l.frame_idx, wy.t::BIGINT AS y, wx.t::BIGINT AS x, {_q('((l.v * (1 - wx.f) + r.v * wx.f) * (1 - wy.f) + (dl.v * (1 - wx.f) + dr.v * wx.f) * wy.f)', '1e5')} AS v
    FROM w wy, w wx JOIN c l ON l.y = wy.a AND l.x = wx.a JOIN c r ON r.frame_idx = l.frame_idx AND r.y = wy.a AND r.x = wx.b
    JOIN c dl ON dl.frame_idx = l.frame_idx AND dl.y = wy.b AND dl.x = wx.a JOIN c dr ON dr.frame_idx = l.frame_idx AND dr.y = wy.b AND dr.x = wx.b""")
def q_bilinear_resize(spark, sf_dir):
    out = spatial.resize(_cells(spark, sf_dir), KEYS, ["v"], (SIDE, SIDE), (12, 12))
    return out.select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"))


@_query(f"""WITH {_CELLS} SELECT frame_idx, ty::BIGINT AS y, tx::BIGINT AS x, v > 0.1e0 AS mask FROM c, (SELECT unnest(generate_series(0, 7)) AS ty), (SELECT unnest(generate_series(0, 3)) AS tx)
    WHERE y = ty AND x = tx * 8 // 4""")
def q_mask_resize(spark, sf_dir):
    mask = _cells(spark, sf_dir).select("frame_idx", "y", "x", (F.col("v") > 0.1).alias("mask"))
    return spatial.resize_mask(mask, KEYS, "mask", (SIDE, SIDE), (SIDE, 4)).select("frame_idx", "y", "x", "mask")


@_query(f"""WITH {_CELLS} SELECT frame_idx, (y - 1) // 2 AS y, (x - 1) // 2 AS x, {_q('greatest(0e0, least(1e0, z * 0.2126e0 + v * 0.7152e0 + (1 - z) * 0.0722e0))')} AS guide FROM c WHERE y % 2 = 1 AND x % 2 = 1""")
def q_depth_guide(spark, sf_dir):
    c = _cells(spark, sf_dir).select("frame_idx", "y", "x", F.col("z").alias("r"), F.col("v").alias("g"), (1 - F.col("z")).alias("b"))
    return spatial.depth_guide(c, KEYS, (SIDE, SIDE), (4, 4)).select("frame_idx", "y", "x", q(F.col("guide")).alias("guide"))


@_query(f"""WITH {_CELLS}, p AS (SELECT frame_idx, y, x, v FROM c UNION ALL SELECT frame_idx, 14 - y, x, v FROM c WHERE y > 3 AND y < 7),
    f AS (SELECT frame_idx, y, x, v FROM p UNION ALL SELECT frame_idx, y, 14 - x, v FROM p WHERE x > 3 AND x < 7) SELECT frame_idx, y, x, {_q('v')} AS v FROM f WHERE y < 10 AND x < 10""")
def q_reflect_pad(spark, sf_dir):
    return layout.reflect_pad(_cells(spark, sf_dir), SIDE, SIDE, 5).select("frame_idx", "y", "x", q(F.col("v")).alias("v"))


@_query(f"WITH {_CELLS} SELECT frame_idx, y, x, {_q('z')} AS z FROM c UNION ALL SELECT frame_idx, y, x + 8, {_q('1 - z')} FROM c")
def q_sbs_combine(spark, sf_dir):
    c = _cells(spark, sf_dir)
    eye = lambda z: c.select("frame_idx", "y", "x", q(z).alias("z"))
    return layout.side_by_side(eye(F.col("z")), eye(1 - F.col("z")), SIDE)


@_query(f"WITH {_CELLS} SELECT frame_idx, (x // 4)::INTEGER AS eye, y, x % 4 AS x, {_q('z')} AS z FROM c")
def q_split_eyes(spark, sf_dir):
    return layout.split_eyes(_cells(spark, sf_dir), SIDE).select("frame_idx", "eye", "y", "x", q(F.col("z")).alias("z"))


# --- rendering


def _splat_sql(direction: str, sep: str, name: str, depth: str = "z") -> str:
    return f"""{name}_t AS (SELECT frame_idx, y, x + {direction}({depth} - 0.25e0) * {sep} * 0.5e0 AS t, v, {depth} AS z FROM c),
    {name}_p AS (SELECT frame_idx, y, floor(t)::BIGINT AS x, v, z, 1 - (t - floor(t)) AS w FROM {name}_t UNION ALL SELECT frame_idx, y, floor(t)::BIGINT + 1, v, z, t - floor(t) FROM {name}_t),
    {name}_m AS (SELECT *, max(z) OVER (PARTITION BY frame_idx, y, x) AS front FROM {name}_p WHERE x BETWEEN 0 AND 7 AND w > 0),
    {name}_a AS (SELECT frame_idx, y, x, max(front) AS front, sum(w) AS w, sum(v * w) AS vw FROM {name}_m WHERE z >= front - 1e-5 GROUP BY frame_idx, y, x),
    {name} AS (SELECT c.frame_idx, c.y, c.x, CASE WHEN w > 1e-8 THEN vw / w END AS v, coalesce(front, 1e0) AS z, NOT coalesce(w > 1e-8, false) AS hole FROM c LEFT JOIN {name}_a a ON a.frame_idx = c.frame_idx AND a.y = c.y AND a.x = c.x)"""


def _fill_sql(inner: str, name: str, most: int) -> str:
    return f"""{name}_n AS (SELECT *, last_value(CASE WHEN NOT hole THEN x END IGNORE NULLS) OVER b AS lx, last_value(CASE WHEN NOT hole THEN z END IGNORE NULLS) OVER b AS lz, last_value(CASE WHEN NOT hole THEN v END IGNORE NULLS) OVER b AS lv,
      first_value(CASE WHEN NOT hole THEN x END IGNORE NULLS) OVER f AS rx, first_value(CASE WHEN NOT hole THEN z END IGNORE NULLS) OVER f AS rz, first_value(CASE WHEN NOT hole THEN v END IGNORE NULLS) OVER f AS rv FROM {inner}
      WINDOW b AS (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {name}_d AS (SELECT *, coalesce(x - lx, 1000000000) AS dl, coalesce(rx - x, 1000000000) AS dr FROM {name}_n),
    {name} AS (SELECT frame_idx, y, x, hole, CASE WHEN NOT hole THEN v ELSE coalesce(CASE WHEN CASE WHEN dl <= {most} AND dr <= {most} THEN CASE WHEN abs(lz - rz) < 0.02e0 THEN dl <= dr ELSE lz < rz END WHEN dl <= {most} THEN true WHEN dr <= {most} THEN false ELSE dl <= dr END THEN lv ELSE rv END, 0e0) END AS v FROM {name}_d)"""


@_query(f"WITH {_CELLS}, {_splat_sql('', '12e0', 's')} SELECT frame_idx, y, x, {_q('v', '1e5')} AS v, {_q('z')} AS z, hole FROM s")
def q_zbuffer(spark, sf_dir):
    c = _cells(spark, sf_dir)
    out = warp.splat(c, KEYS, ["v"], "z", px.disparity(F.col("z"), 0.25, 12.0) * 0.5, SIDE)
    return out.select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"), q(F.col("z")).alias("z"), "hole")


@_query(f"WITH {_CELLS}, {_splat_sql('', '12e0', 's')}, {_fill_sql('s', 'h', 2)} SELECT frame_idx, y, x, {_q('v', '1e5')} AS v, hole FROM h")
def q_hole_fill(spark, sf_dir):
    c = _cells(spark, sf_dir)
    out = warp.splat(c, KEYS, ["v"], "z", px.disparity(F.col("z"), 0.25, 12.0) * 0.5, SIDE)
    return warp.fill_holes(out, KEYS, ["v"], "z", max_distance=2).select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"), "hole")


@_query(f"""WITH {_CELLS}, p AS (SELECT *, greatest(0e0, least(7e0, x - (z - 0.25e0) * 4e0 * 0.5e0)) AS t FROM c)
    SELECT p.frame_idx, p.y, p.x, {_q('l.v * (1 - (t - floor(t))) + r.v * (t - floor(t))', '1e5')} AS v FROM p
    JOIN c l ON l.frame_idx = p.frame_idx AND l.y = p.y AND l.x = floor(t) JOIN c r ON r.frame_idx = p.frame_idx AND r.y = p.y AND r.x = least(7, floor(t) + 1)""")
def q_backward_warp(spark, sf_dir):
    c = _cells(spark, sf_dir)
    out = warp.backward_warp(c, KEYS, ["v"], px.disparity(F.col("z"), 0.25, 4.0) * 0.5, SIDE)
    return out.select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"))


def _half_sql(eye: str, name: str) -> str:
    """Antialiased halving of eight columns: a triangle two wide, cut off and made to sum to 1 at the edges."""
    taps = "(SELECT t, s, greatest(0e0, 1 - abs(s - (t * 2 + 0.5e0)) / 2) AS w FROM (SELECT unnest(generate_series(0, 3)) AS t), (SELECT unnest(generate_series(0, 7)) AS s))"
    return f"{name} AS (SELECT frame_idx, y, t::BIGINT AS x, sum(v * w) / sum(w) AS v, bool_or(hole AND s = t * 2) AS hole FROM {eye} JOIN {taps} k ON k.s = {eye}.x AND k.w > 0 GROUP BY frame_idx, y, t)"


@_query(f"""WITH {_CELLS}, {_splat_sql('', '12e0', 'l')}, {_splat_sql('-', '12e0', 'r')}, {_fill_sql('l', 'lf', 3)}, {_fill_sql('r', 'rf', 3)}, {_half_sql('lf', 'lh')}, {_half_sql('rf', 'rh')},
    b AS (SELECT * FROM lh UNION ALL SELECT frame_idx, y, x + 4, v, hole FROM rh) SELECT frame_idx, y, x, {_q('greatest(0e0, least(1e0, v))', '1e5')} AS v, hole FROM b""")
def q_stereo_half_sbs(spark, sf_dir):
    left, right = warp.render_stereo(_cells(spark, sf_dir), KEYS, ["v"], "z", (SIDE, SIDE), max_eye_px=6.0, zero_parallax=0.25, max_fill_distance=3, half=True)
    return layout.side_by_side(left, right, SIDE // 2).select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"), "hole")


# --- aggregates and ordered operators


@_query(f"""WITH {_CELLS}, p AS (SELECT frame_idx, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY frame_idx)
    SELECT frame_idx, {_q('lo')} AS low, {_q('CASE WHEN hi <= lo + 1e-8 THEN lo + 1e-6 ELSE hi END')} AS high FROM p""")
def q_percentile_bounds(spark, sf_dir):
    return temporal.percentile_bounds(_cells(spark, sf_dir), KEYS, "v", size=(SIDE, SIDE)).select("frame_idx", q(F.col("low")).alias("low"), q(F.col("high")).alias("high"))


_MAD = """f AS (SELECT vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    d AS (SELECT a.frame_idx, a.e, b.e AS n, (SELECT sum(abs(a.e[i] - b.e[i])) / 64 FROM (SELECT unnest(generate_series(1, 64)) AS i)) AS mad FROM f a LEFT JOIN f b ON b.frame_idx = a.frame_idx + 1)"""


@_query(f"WITH {_MAD} SELECT frame_idx, coalesce(n IS NOT NULL AND mad >= 0.14e0, false) AS cut FROM d")
def q_scene_cut(spark, sf_dir):
    return temporal.cut_after(_frames(spark, sf_dir), [], "frame_idx", "e", 0.14).select("frame_idx", "cut")


@_query(f"""WITH {_CELLS}, w AS (SELECT t, t * 8 / 12e0 + 4 / 12e0 - 0.5e0 AS pos FROM (SELECT unnest(generate_series(0, 11)) AS t)), p AS (SELECT t, floor(pos) + k AS s, abs(pos - floor(pos) - k) AS d FROM w, (SELECT unnest(generate_series(-1, 2)) AS k)),
    g AS (SELECT t, greatest(0, least(7, s)) AS s, CASE WHEN d <= 1 THEN 1.25e0 * d * d * d - 2.25e0 * d * d + 1 ELSE -0.75e0 * d * d * d + 3.75e0 * d * d - 6 * d + 3 END AS w FROM p)
    SELECT frame_idx, a.t AS y, b.t AS x, {_q('sum(v * a.w * b.w)', '1e5')} AS v FROM c JOIN g a ON a.s = c.y JOIN g b ON b.s = c.x GROUP BY frame_idx, a.t, b.t""")
def q_cubic_resize(spark, sf_dir):
    out = spatial.resize(_cells(spark, sf_dir), KEYS, ["v"], (SIDE, SIDE), (12, 12), kernel="cubic")
    return out.select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"))


@_query(f"""WITH {_CELLS}, n AS (SELECT max(frame_idx) AS last FROM c), o AS (SELECT c.*, unnest(generate_series((frame_idx * 30 + 23) // 24, ((frame_idx + 1) * 30 + 23) // 24 - 1)) AS idx FROM c)
    SELECT idx AS frame_idx, y, x - 2 AS x, {_q('v', '1e5')} AS v FROM o WHERE x BETWEEN 2 AND 5 AND y BETWEEN 0 AND 7""")
def q_decode_chain(spark, sf_dir):
    """24 frames a second as 30, the middle of the picture at another shape."""
    out, size = layout.decode_chain(_cells(spark, sf_dir), [], "frame_idx", ["v"], (SIDE, SIDE), rate=24, force_rate=30, to=(SIDE, SIDE // 2))
    return out.select("frame_idx", "y", "x", q(F.col("v"), 1e5).alias("v"))


@_query(f"""WITH {_CELLS}, g AS (SELECT frame_idx, y // 4 AS cy, x // 2 AS cx, avg(z) * 0.2126e0 + avg(v) * 0.7152e0 + avg(1 - z) * 0.0722e0 AS l FROM c GROUP BY frame_idx, y // 4, x // 2),
    d AS (SELECT a.frame_idx, avg(abs(a.l - b.l)) AS mad FROM g a LEFT JOIN g b ON b.frame_idx = a.frame_idx + 1 AND b.cy = a.cy AND b.cx = a.cx GROUP BY a.frame_idx) SELECT frame_idx, coalesce(mad >= 0.05e0, false) AS cut FROM d""")
def q_luma_proxy_cut(spark, sf_dir):
    """Cuts found on small luma pictures that are averages over areas."""
    c = _cells(spark, sf_dir).select("frame_idx", "y", "x", F.col("z").alias("r"), F.col("v").alias("g"), (1 - F.col("z")).alias("b"))
    proxy = temporal.luma_proxy(c, KEYS, ["r", "g", "b"], (SIDE, SIDE), to=(2, 4))
    return temporal.cut_after(proxy, [], "frame_idx", "proxy", 0.05).select("frame_idx", "cut")


@_query(f"""WITH {_CELLS}, t AS (SELECT * FROM c WHERE y % 4 = 0 AND x % 4 = 0), d AS (SELECT a.frame_idx, avg((abs(a.z - b.z) * 2 + abs(a.v - b.v)) / 3) AS mad FROM t a LEFT JOIN t b ON b.frame_idx = a.frame_idx - 1 AND b.y = a.y AND b.x = a.x GROUP BY a.frame_idx)
    SELECT frame_idx, coalesce(mad >= 0.1e0, false) AS cut FROM d""")
def q_thumbnail_cut(spark, sf_dir):
    """Cuts found on raw colours at every fourth pixel."""
    c = _cells(spark, sf_dir).select("frame_idx", "y", "x", F.col("z").alias("r"), F.col("v").alias("g"), (1 - F.col("z")).alias("b"))
    thumb = temporal.thumbnail(c, KEYS, ["r", "g", "b"], (SIDE, SIDE), side=2)
    return temporal.cut_before(thumb, [], "frame_idx", "thumb", 0.1).select("frame_idx", "cut")


@_query(f"""WITH {_CELLS}, d AS (SELECT frame_idx, y, x, z FROM c WHERE y < 8) SELECT c.frame_idx, c.y, c.x, {_q('c.v')} AS v, {_q('d.z')} AS z FROM c JOIN d USING (frame_idx, y, x)""")
def q_join_depth(spark, sf_dir):
    """Colour and depth pixels by place, an error where one side lacks a frame."""
    c = _cells(spark, sf_dir)
    both = warp.join_depth(c.select("frame_idx", "y", "x", "v"), c.select("frame_idx", "y", "x", "z"), ["frame_idx", "y", "x"])
    return both.select("frame_idx", "y", "x", q(F.col("v")).alias("v"), q(F.col("z")).alias("z"))


_EMA = f"""{_EVENTS}, k AS (SELECT *, coalesce(abs(v - prev_v) >= 50e0, false) AS cut FROM s)"""


_NORM_EMA = f"""WITH RECURSIVE {_EMA}, r AS (SELECT user_id, idx, v AS lo, v + 10 AS hi FROM k WHERE idx = 0
    UNION ALL SELECT k.user_id, k.idx, CASE WHEN k.cut THEN k.v ELSE 0.95e0 * r.lo + (1 - 0.95e0) * k.v END, CASE WHEN k.cut THEN k.v + 10 ELSE 0.95e0 * r.hi + (1 - 0.95e0) * (k.v + 10) END FROM r JOIN k ON k.user_id = r.user_id AND k.idx = r.idx + 1)
    SELECT user_id, idx, {_q('lo', '1e5')} AS norm_low, {_q('hi', '1e5')} AS norm_high FROM r"""


@_query(_NORM_EMA)
def q_norm_ema(spark, sf_dir):
    v = F.col("v")
    e = _events(spark, sf_dir).select("user_id", "idx", v.alias("low"), (v + 10).alias("high"), F.coalesce(F.abs(v - F.col("prev_v")) >= 50, F.lit(False)).alias("cut"))
    out = temporal.smooth_bounds(e, ["user_id"], "idx")
    return out.select("user_id", "idx", q(F.col("norm_low"), 1e5).alias("norm_low"), q(F.col("norm_high"), 1e5).alias("norm_high"))


@_query(f"""WITH RECURSIVE {_CELLS}, f AS (SELECT vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    p AS (SELECT frame_idx, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY frame_idx),
    k AS (SELECT f.frame_idx, lo, hi, coalesce((SELECT sum(abs(f.e[i] - b.e[i])) / 64 >= 0.14e0 FROM (SELECT unnest(generate_series(1, 64)) AS i)), false) AS cut FROM f JOIN p USING (frame_idx) LEFT JOIN f b ON b.frame_idx = f.frame_idx - 1),
    r AS (SELECT frame_idx, lo, hi FROM k WHERE frame_idx = 0 UNION ALL SELECT k.frame_idx, CASE WHEN cut THEN k.lo ELSE 0.95e0 * r.lo + (1 - 0.95e0) * k.lo END, CASE WHEN cut THEN k.hi ELSE 0.95e0 * r.hi + (1 - 0.95e0) * k.hi END FROM r JOIN k ON k.frame_idx = r.frame_idx + 1)
    SELECT c.frame_idx, y, x, {_q('1 - greatest(0e0, least(1e0, (v - lo) / greatest(hi - lo, 1e-6)))', '1e5')} AS norm FROM c JOIN r USING (frame_idx)""")
def q_normalise_frames(spark, sf_dir):
    cuts = temporal.cut_before(_frames(spark, sf_dir), [], "frame_idx", "e", 0.14).select("frame_idx", "cut")
    cells = _cells(spark, sf_dir)
    bounds = temporal.smooth_bounds(temporal.percentile_bounds(cells, KEYS, "v").join(cuts, KEYS), [], "frame_idx")
    norm = temporal.normalised(F.col("v"), F.col("norm_low"), F.col("norm_high"), inverted=True)
    return cells.join(bounds.select("frame_idx", "norm_low", "norm_high"), KEYS).select("frame_idx", "y", "x", q(norm, 1e5).alias("norm"))


_STABLE = f"""WITH RECURSIVE {_EVENTS}, r AS (SELECT user_id, idx, v FROM s WHERE idx = 0
    UNION ALL SELECT s.user_id, s.idx, CASE WHEN abs(s.v - r.v) >= 40e0 THEN s.v ELSE s.v + 0.15e0 * (r.v - s.v) END FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1)
    SELECT user_id, idx, {_q('v', '1e5')} AS stable FROM r"""


@_query(_STABLE)
def q_disp_stability(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "idx", "v")
    return temporal.stabilise(e, ["user_id"], ["idx"], "v", threshold=40.0).select("user_id", "idx", q(F.col("stable"), 1e5).alias("stable"))


@_query(f"""WITH {_EVENTS}, g AS (SELECT user_id, regr_slope(next_v, v) AS m, regr_intercept(next_v, v) AS b FROM s WHERE next_v IS NOT NULL GROUP BY user_id)
    SELECT user_id, {_q('coalesce(CASE WHEN isfinite(m) THEN m END, 1e0)', '1e5')} AS scale, {_q('coalesce(CASE WHEN isfinite(m) THEN b END, 0e0)', '1e3')} AS shift FROM g""")
def q_lsq_align(spark, sf_dir):
    e = _events(spark, sf_dir).where("next_v IS NOT NULL")
    out = temporal.least_squares(e, ["user_id"], "v", "next_v")
    return out.select("user_id", q(F.col("scale"), 1e5).alias("scale"), q(F.col("shift"), 1e3).alias("shift"))


def _dense_sql(m: int, tail: bool, cut: str) -> str:
    last = m - 1 if tail else 0
    return f"""WITH {_EVENTS}, d AS (SELECT *, unnest(generate_series(0, CASE WHEN next_v IS NULL THEN {last} ELSE {m - 1} END)) AS j FROM s)
    SELECT user_id, (idx * {m} + j)::BIGINT AS out_idx, {_q(f'CASE WHEN j = 0 OR next_v IS NULL OR {cut} THEN v ELSE v * (1 - j / {m}e0) + next_v * (j / {m}e0) END', '1e5')} AS v FROM d"""


def _dense(e: DataFrame, m: int, **how) -> DataFrame:
    return temporal.densify(e, ["user_id"], "idx", "v", m, following="next_v", **how).select("user_id", "out_idx", q(F.col("v"), 1e5).alias("v"))


@_query(_dense_sql(4, True, "false"))
def q_densify_4x(spark, sf_dir):
    return _dense(_events(spark, sf_dir), 4)


@_query(_dense_sql(4, True, "abs(next_v - v) >= 30e0"))
def q_densify_cut_hold(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("cut", F.coalesce(F.abs(F.col("next_v") - F.col("v")) >= 30, F.lit(False)))
    return _dense(e, 4, cut="cut")


@_query(_dense_sql(3, False, "false"))
def q_densify_no_tail(spark, sf_dir):
    return _dense(_events(spark, sf_dir), 3, tail=False)


@_query(f"WITH {_EVENTS} SELECT user_id, idx AS out_idx, {_q('v', '1e5')} AS v FROM s")
def q_passthrough(spark, sf_dir):
    return _dense(_events(spark, sf_dir), 1)


@_query(f"WITH {_EVENTS} SELECT user_id, idx // 24 AS chunk, count(*) AS n, max(idx % 24)::INTEGER AS last_place FROM s GROUP BY user_id, idx // 24")
def q_chunks(spark, sf_dir):
    return temporal.chunked(_events(spark, sf_dir), "idx", 24).groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.max("place").alias("last_place"))


_WINDOWS = """n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), w AS (SELECT unnest(generate_series(0, (n - 1) // 22)) AS w, n FROM n),
    p AS (SELECT w, n, unnest(generate_series(0, 31)) AS place FROM w), h AS (SELECT w AS "window", place::INTEGER AS place, least(w * 22 + place, n - 1) AS frame_idx, w * 22 + place >= n AS padded FROM p)"""


_CELL = "(SELECT unnest(generate_series(0, 63))::INTEGER AS cell)"
#: A frame's weight in a window; l.last is the stream's last window.
_WEIGHT = """CASE WHEN "window" > 0 AND place < 2 THEN 0 WHEN "window" > 0 AND place < 10 THEN (place - 2) / 7e0 WHEN place < 24 OR "window" = last THEN 1 ELSE 1 - (place - 24) / 7e0 END"""


def _by_cell(frames: DataFrame, values: str, *columns: str) -> DataFrame:
    """A row per cell of a frame: the columns, cell and v."""
    return frames.select(*columns, F.posexplode(values).alias("cell", "v"))


@_query(f"""WITH {_WINDOWS} SELECT "window", place, frame_idx, padded, cell, {_q('e.embedding[cell + 1]::DOUBLE')} AS v FROM h JOIN embeddings e ON e.vec_id = h.frame_idx, {_CELL}""")
def q_hop_windows(spark, sf_dir):
    out = temporal.hop_windows(_frames(spark, sf_dir), [], "frame_idx", ["e"])
    return _by_cell(out, "e", "window", "place", "frame_idx", "padded").withColumn("v", q(F.col("v")))


@_query(f"""WITH {_WINDOWS}, m AS (SELECT max("window") AS last FROM h), r AS (SELECT h.*, last, cell, embedding[cell + 1]::DOUBLE * (1 + h."window" / 1e3) AS v FROM h, m, {_CELL} JOIN embeddings e ON e.vec_id = h.frame_idx WHERE NOT padded)
    SELECT frame_idx, cell, {_q(f'sum(v * {_WEIGHT})', '1e5')} AS v FROM r GROUP BY frame_idx, cell""")
def q_crossfade(spark, sf_dir):
    wins = temporal.hop_windows(_frames(spark, sf_dir), [], "frame_idx", ["e"]).where("NOT padded").withColumn("e", F.transform("e", lambda v: v * (1 + F.col("window") / 1e3)))
    plain = wins.select("window").distinct().select("window", F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    floored = wins.withColumn("e", F.transform("e", lambda v: v + 100))  # the floor at 0 stays out of it
    out = temporal.blend_windows(floored, [], "frame_idx", "e", plain)
    return _by_cell(out, "e", "frame_idx").withColumn("v", q(F.col("v") - 100, 1e5))


def _chain_sql(depth: str) -> str:
    """The alignment chain as a recursion over windows: of each, three frames' depths as lists. ``depth`` is that of x in a window w
    whose first frame begins with b."""
    lists = ", ".join(f"list_transform(e{p}.embedding, lambda x: {depth.replace('{x}', 'x::DOUBLE').replace('{b}', 'e0.embedding[1]::DOUBLE')}) AS p{p}" for p in (0, 1, 12))
    joins = " ".join(f"JOIN embeddings e{p} ON e{p}.vec_id = least(w * 22 + {p}, n - 1)" for p in (0, 1, 12))
    fitted = "SELECT w, a, p12, (128 * gt - sg * st) / (128 * gg - sg * sg) AS scale, sg, st FROM (SELECT w, a, p12, list_sum(g) AS sg, list_sum(t) AS st, list_inner_product(g, g) AS gg, list_inner_product(g, t) AS gt FROM (SELECT d.w, c.a, d.p12, list_concat(d.p0, d.p1) AS g, list_concat(c.a, c.b) AS t FROM chain c JOIN d ON d.w = c.w + 1))"
    return f"""WITH RECURSIVE {_WINDOWS}, m AS (SELECT max("window") AS last FROM h), d AS (SELECT w, e0.embedding[1]::DOUBLE AS b, {lists} FROM w {joins}),
    chain AS (SELECT w, p0 AS a, p12 AS b, 1e0 AS scale, 0e0 AS shift FROM d WHERE w = 0
        UNION ALL SELECT w, a, list_transform(p12, lambda x: greatest(0e0, x * scale + (st - scale * sg) / 128)), scale, (st - scale * sg) / 128 FROM ({fitted})),
    r AS (SELECT h.*, last, cell, scale, shift, {depth.replace('{x}', 'embedding[cell + 1]::DOUBLE').replace('{b}', 'd.b').replace('w ', 'h."window" ').replace('(w', '(h."window"')} AS v FROM h, m, {_CELL} JOIN embeddings e ON e.vec_id = h.frame_idx JOIN chain ON chain.w = h."window" JOIN d ON d.w = h."window" WHERE NOT padded)
    SELECT frame_idx, cell, {_q(f'sum(CASE WHEN "window" = 0 THEN v ELSE greatest(0e0, v * scale + shift) END * {_WEIGHT})', '1e4')} AS v FROM r GROUP BY frame_idx, cell"""


@_query(_chain_sql("({x} + 1) * (1 + w / 10e0) + w / 7e0"))
def q_align_chain(spark, sf_dir):
    """Windows whose depths each have a scale and shift of their own, brought back onto one chain."""
    wins = temporal.hop_windows(_frames(spark, sf_dir), [], "frame_idx", ["e"]).withColumn("d", F.transform("e", lambda v: (v + 1) * (1 + F.col("window") / 10) + F.col("window") / 7))
    aligned = temporal.align_chain(wins, [], "d")
    out = temporal.blend_windows(wins, [], "frame_idx", "d", aligned)
    return _by_cell(out, "d", "frame_idx").withColumn("v", q(F.col("v"), 1e4))


@_query("""SELECT frame_idx // 22 AS "window", [0, 12, 24, 25, 26, 27, 28, 29, 30, 31][k]::INTEGER AS place,
    CASE WHEN k = 1 THEN 0 ELSE (frame_idx // 22 - 1) * 22 + [0, 12, 24, 25, 26, 27, 28, 29, 30, 31][k] END::BIGINT AS source
    FROM (SELECT vec_id AS frame_idx, unnest(generate_series(1, 10)) AS k FROM embeddings WHERE vec_id % 22 = 0 AND vec_id > 0)""")
def q_keyframes(spark, sf_dir):
    w = _frames(spark, sf_dir).where("frame_idx % 22 = 0 AND frame_idx > 0").select(F.floor(F.col("frame_idx") / 22).cast("long").alias("window"))
    rows = w.select("window", F.posexplode(temporal.keyframe_inputs(F.col("window"))).alias("k", "source"))
    return rows.select("window", F.get(F.array(*map(F.lit, temporal.KEYFRAMES)), F.col("k")).alias("place"), "source")


@_query(f"WITH {_CELLS} SELECT count(*) AS cells, count(DISTINCT frame_idx) AS frames, count(*) = 64 * count(DISTINCT frame_idx) AS whole FROM c")
def q_invariants(spark, sf_dir):
    c = _cells(spark, sf_dir).groupBy("frame_idx").agg(F.count("*").alias("n"))
    return c.agg(F.sum("n").alias("cells"), F.count("*").alias("frames"), (F.sum("n") == SIDE * SIDE * F.count("*")).alias("whole"))


# --- sinks, sources, streams


@_query("""SELECT codec, rate_control, valid, quality_min, quality_max FROM (VALUES
    ('x264', 'lossless', true, NULL, NULL), ('x264', 'constant_quality', true, 0, 51), ('x264', 'cqp', false, NULL, NULL), ('x264', 'vbr', true, NULL, NULL),
    ('x265', 'lossless', true, NULL, NULL), ('x265', 'constant_quality', true, 0, 51), ('x265', 'cqp', false, NULL, NULL), ('x265', 'vbr', true, NULL, NULL),
    ('av1', 'lossless', false, NULL, NULL), ('av1', 'constant_quality', true, 0, 63), ('av1', 'cqp', false, NULL, NULL), ('av1', 'vbr', true, NULL, NULL),
    ('av1_vaapi', 'lossless', false, NULL, NULL), ('av1_vaapi', 'constant_quality', true, 1, 255), ('av1_vaapi', 'cqp', true, 1, 255), ('av1_vaapi', 'vbr', true, NULL, NULL)) t(codec, rate_control, valid, quality_min, quality_max)""")
def q_encoder_matrix(spark, sf_dir):
    return encoder.matrix(spark)


def _streamed(spark: SparkSession, rows: DataFrame, batch: int, columns: list[str]) -> DataFrame:
    """Rows stream_id, idx and columns as a stream: three micro-batches cut at multiples of ``batch``, ends in the last. Each is as
    many files as the session has cores: a row without an index, which isn't read, keeps a file from being left out."""
    folder, files = shared_folder(spark, "stream"), max(1, spark.sparkContext.defaultParallelism)
    given = rows.select(F.col("stream_id").cast("string").alias("stream_id"), "idx", *columns, F.lit(False).alias("is_eof"))
    at = F.least(F.lit(2).cast("long"), F.floor(F.col("idx") / batch)).cast("int").alias("batch")
    given.select("*", at).write.partitionBy("batch").parquet(f"{folder}/cut")  # once, for all three
    cut = spark.read.schema(given.select("*", at).schema).parquet(f"{folder}/cut")
    nulls = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in columns]
    ends = cut.groupBy("stream_id").agg((F.max("idx") + 1).alias("idx")).select("stream_id", "idx", *nulls, F.lit(True).alias("is_eof"))
    for k in range(3):
        part = cut.where(F.col("batch") == k).drop("batch")
        part = (part.unionByName(ends) if k == 2 else part).withColumn("_file", F.pmod(F.hash("stream_id", "idx"), F.lit(files)))
        part = part.unionByName(spark.range(files).select(F.col("id").cast("int").alias("_file")), allowMissingColumns=True)
        part.repartitionById(files, F.col("_file")).drop("_file").write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", str(files)).parquet(f"{folder}/in/*")
    return stream.where("idx IS NOT NULL")


def _ended(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream has given when its source has ended."""
    folder = shared_folder(spark, "streamed")
    series.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("stream_id", F.col("user_id"))


def _frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as one stream."""
    return _frames(spark, sf_dir).select(F.lit(0).alias("stream_id"), F.col("frame_idx").alias("idx"), F.col("e").alias("v"))


@_query(_dense_sql(4, True, "false"))
def q_stream_densify(spark, sf_dir):
    """The series cut into micro-batches, with state between them: the same rows as in one go."""
    out = _ended(spark, series.densify_stream(_streamed(spark, _event_stream(spark, sf_dir), 30, ["v"]), 4))
    return out.select(F.col("stream_id").alias("user_id"), "out_idx", q(F.col("v"), 1e5).alias("v"))


@_query(_NORM_EMA)
def q_stream_bounds(spark, sf_dir):
    """The running bounds as a stream."""
    e = _event_stream(spark, sf_dir).withColumns({"low": F.col("v"), "high": F.col("v") + 10, "cut": F.coalesce(F.abs(F.col("v") - F.col("prev_v")) >= 50, F.lit(False))})
    out = _ended(spark, series.bounds_stream(_streamed(spark, e, 30, ["low", "high", "cut"])))
    return out.select(F.col("stream_id").alias("user_id"), "idx", q(F.col("norm_low"), 1e5).alias("norm_low"), q(F.col("norm_high"), 1e5).alias("norm_high"))


@_query(_STABLE)
def q_stream_stability(spark, sf_dir):
    """Depth stability as a stream of fields, here of one cell."""
    e = _event_stream(spark, sf_dir).withColumn("v", F.array("v"))
    out = _ended(spark, series.stability_stream(_streamed(spark, e, 30, ["v"]), groups=series.GROUPS, threshold=40.0))
    return out.select(F.col("stream_id").alias("user_id"), "idx", q(F.get("stable", 0), 1e5).alias("stable"))


@_query(f"""WITH {_CELLS}, {_MAD}, m AS (SELECT frame_idx, coalesce(mad >= 0.14e0, false) AS cut FROM d),
    j AS (SELECT c.*, b.v AS nv, m.cut FROM c JOIN m USING (frame_idx) LEFT JOIN c b ON b.frame_idx = c.frame_idx + 1 AND b.y = c.y AND b.x = c.x), o AS (SELECT *, unnest(generate_series(0, 3)) AS k FROM j)
    SELECT frame_idx * 4 + k AS out_idx, (y * 8 + x)::INTEGER AS cell, {_q('CASE WHEN k = 0 OR nv IS NULL OR cut THEN v ELSE v * (1 - k / 4e0) + nv * (k / 4e0) END', '1e5')} AS v FROM o""")
def q_stream_frames(spark, sf_dir):
    """Whole frames densified as a stream, with cuts held and the exact tail."""
    out = _ended(spark, series.densify_stream(_streamed(spark, _frame_stream(spark, sf_dir), 100, ["v"]), 4, threshold=0.14))
    return _by_cell(out, "v", "out_idx").withColumn("v", q(F.col("v"), 1e5))


def _tilted(window):
    """A stand-in depth model whose scale and shift depend on the window's first value."""
    first = window[0, 0]
    return (window + 1) * (2 + first) + first


@_query(_chain_sql("({x} + 1) * (2 + {b}) + {b}"))
def q_stream_windows(spark, sf_dir):
    """Depth windows as a stream: windowed, modelled, aligned on the chain and cross-faded between micro-batches."""
    rows = _streamed(spark, _frame_stream(spark, sf_dir).withColumnRenamed("v", "values"), 100, ["values"])
    out = _ended(spark, series.depth_window_stream(rows, _tilted))
    return _by_cell(out, "depth", F.col("idx").alias("frame_idx")).withColumn("v", q(F.col("v"), 1e4))


@_query(f"WITH {_CELLS} SELECT frame_idx, y, x, floor(z * 65535 + 0.5e0)::INTEGER AS u16 FROM c")
def q_stream_sink(spark, sf_dir):
    """Frames written batch by batch by the stream's sink, their number checked at the end, and read back."""
    spark.dataSource.register(rawframes.RawFrames)
    folder = shared_folder(spark, "frames")
    stream = series.densify_stream(_streamed(spark, _frame_stream(spark, sf_dir), 100, ["v"]), 1)
    rgb = stream.withColumn("rgb", F.flatten(F.transform("v", lambda v: F.array_repeat(px.clamp01(v + 0.5), 3))))
    packed = rawframes.pack(rgb.select("out_idx", "rgb"), "rgb", "rgb48le").select("out_idx", "data")
    series.run_to_end(packed, folder, f"{shared_folder(spark, 'checkpoint')}", form="rawframes")
    rawframes.finish(folder, _frames(spark, sf_dir).count())
    return _read_back(spark, folder)


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.format("rawframes").options(width=SIDE, height=SIDE, pix_fmt="rgb48le", path=folder).load()
    cells = rawframes.unpack(read.select("frame_idx", "pix_fmt", "data")).select("frame_idx", F.posexplode("rgb").alias("at", "v")).where("at % 3 = 0")
    at = (F.col("at") / 3).cast("long")
    return cells.select("frame_idx", F.floor(at / SIDE).cast("long").alias("y"), (at % SIDE).alias("x"), F.round(F.col("v").cast("double") * 65535).cast("int").alias("u16"))


@_query(f"WITH {_CELLS} SELECT frame_idx, y, x, floor(z * 65535 + 0.5e0)::INTEGER AS u16 FROM c")
def q_frame_roundtrip(spark, sf_dir):
    """Depth written as raw 16-bit frames in order and read back through the data source."""
    spark.dataSource.register(rawframes.RawFrames)
    rgb = F.flatten(F.transform("e", lambda v: F.array_repeat(px.clamp01(v + 0.5), 3)))
    frames = rawframes.pack(_frames(spark, sf_dir).select(F.col("frame_idx").alias("out_idx"), rgb.alias("rgb")), "rgb", "rgb48le")
    folder = shared_folder(spark, "frames")
    rawframes.write_ordered(frames, folder, partitions=4)
    return _read_back(spark, folder)


@_query(f"""WITH {_CELLS}, {_MAD}, p AS (SELECT frame_idx, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY frame_idx),
    m AS (SELECT d.frame_idx, coalesce(mad >= 0.14e0, false) AS cut, n IS NULL AS last FROM d),
    z AS (SELECT c.frame_idx, y, x, greatest(0e0, least(1e0, (v - lo) / greatest(hi - lo, 1e-6))) AS n FROM c JOIN p USING (frame_idx)),
    j AS (SELECT z.*, b.n AS nn, m.cut FROM z JOIN m USING (frame_idx) LEFT JOIN z b ON b.frame_idx = z.frame_idx + 1 AND b.y = z.y AND b.x = z.x),
    o AS (SELECT *, unnest(generate_series(0, 3)) AS k FROM j)
    SELECT frame_idx * 4 + k AS out_idx, y, x, {_q('CASE WHEN k = 0 OR nn IS NULL OR cut THEN n ELSE n * (1 - k / 4e0) + nn * (k / 4e0) END', '1e5')} AS v FROM o""")
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, their cuts and percentile bounds, normalised and densified four times with an exact tail."""
    frames = temporal.cut_after(_frames(spark, sf_dir), [], "frame_idx", "e", 0.14)
    lo, hi = (F.percentile("v", F.lit(p)) for p in (0.02, 0.98))
    bounds = layout.to_pixels(frames, KEYS, "e", SIDE).groupBy("frame_idx").agg(lo.alias("low"), hi.alias("high"))
    norm = frames.join(bounds, KEYS).select("frame_idx", "cut", F.transform("e", lambda v: temporal.normalised(v, F.col("low"), F.col("high"))).alias("n"))
    dense = temporal.densify(norm, [], "frame_idx", "n", 4, cut="cut")
    return layout.to_pixels(dense, ["out_idx"], "n", SIDE).select("out_idx", "y", "x", q(F.col("v"), 1e5).alias("v"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
