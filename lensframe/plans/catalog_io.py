"""Round trips of the readers and writers, reuse, and the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.operators import reuse
from lensframe.plans.catalog import rounded
from lensframe.plans.domain import cameras, sql, view
from lensframe.session import work_path
from lensframe.sources import sinks, text_model
from lensframe.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle)
        return f

    return add


def scene(c):
    """The scene of a written folder scene=<value>."""
    return F.regexp_extract(c, "scene=([^/]*)", 1).cast("long").alias("scene_id")


def _cameras(s, d):
    return cameras(s, d).withColumns({"scene": F.col("scene_id"), "camera_id": F.col("i")})


@query("SELECT scene_id, i AS camera_id, 'PINHOLE' AS model, round(CAST(f AS DOUBLE), 6) AS f, 320.0::DOUBLE AS cx FROM cam")
def sink_scene_text_cameras(s, d):
    path = work_path(s, "cams")
    sinks.sink_cameras(_cameras(s, d), path)
    t = text_model.src_cameras(s, path, "part-*")
    return t.select(scene("scene"), "camera_id", "model", F.round(F.col("params")[0], 6).alias("f"), F.col("params")[2].alias("cx"))


@query("""SELECT c.scene_id, c.i AS image_id, round(c.tx, 6) AS x, round(c.tz, 6) AS z, count(o.track_id) AS n FROM cam c LEFT JOIN obs o ON c.i = o.i GROUP BY ALL""")
def sink_scene_text(s, d):
    """Images and their points through the text model and back."""
    path = work_path(s, "images")
    c = _cameras(s, d)
    sinks.sink_images(c.withColumn("name", F.replace("name", F.lit("#"), F.lit("-"))), view(s, d, "obs").join(c.select("i", "scene"), "i"), path)
    im = text_model.src_images(s, path, "part-*")
    n = text_model.src_image_points(im).groupBy("scene", "image_id").agg(F.count("*").alias("n"))
    return rounded(im.join(n, ["scene", "image_id"], "left").select(scene("scene"), "image_id", "t.x", "t.z", F.coalesce("n", F.lit(0)).alias("n")))


@query("""SELECT c.scene_id, p.track_id AS point_id, round(p.x, 6) AS x, p.r, count(*) AS n FROM points p JOIN obs o ON p.track_id = o.track_id JOIN cam c ON o.i = c.i GROUP BY ALL""")
def src_points(s, d):
    path = work_path(s, "points")
    o = view(s, d, "obs").join(_cameras(s, d).select("i", "scene"), "i")
    sinks.sink_points(view(s, d, "points").withColumn("error", F.lit(0.5)), o, path)
    # A point is one line, so what its track counts is counted where the line is read, which is done once.
    t = text_model.src_tracks(text_model.src_points(s, path, "part-*"), "x", "r")
    n = t.groupBy("scene", "point_id", "x", "r").agg(F.count("*").alias("n"))
    return rounded(n.select(scene("scene"), "point_id", "x", "r", "n"))


@query("SELECT run, grp, metric, round(value, 6) AS value FROM metrics")
def sink_metrics_json(s, d):
    path = work_path(s, "metrics")
    sinks.sink_metrics_json(view(s, d, "metrics"), path)
    lines = s.read.text(path).select("run", F.explode(F.from_json("value", "map<string,map<string,struct<full_data:array<double>>>>")).alias("grp", "m"))
    return rounded(lines.select("run", "grp", F.explode("m").alias("metric", "v")).select("run", "grp", "metric", F.explode("v.full_data").alias("value")))


@query("SELECT i, j, round(score, 9) AS score FROM edges")
def sink_tsv(s, d):
    path = work_path(s, "tsv")
    sinks.sink_tsv(view(s, d, "edges"), path)
    return rounded(s.read.schema("i long, j long, score double").option("sep", "\t").option("header", True).csv(path), 9)


@query("SELECT e.i, e.j FROM edges e JOIN images a ON e.i = a.i JOIN images b ON e.j = b.i")
def sink_named_pairs(s, d):
    path = work_path(s, "named")
    im = view(s, d, "images")
    sinks.sink_named_pairs(view(s, d, "edges"), im, path)
    t = s.read.text(path).select(F.split("value", " ").alias("f")).select(F.concat_ws("-", F.col("f")[1], F.col("f")[2]).alias("value"))
    n = im.select("name", "i")
    p = F.split("value", "-")
    x = t.select(p[0].alias("a"), p[1].alias("b"))
    return x.join(n.select(F.col("name").alias("a"), "i"), "a").join(n.select(F.col("name").alias("b"), F.col("i").alias("j")), "b").select("i", "j")


@query("""SELECT scene_id AS scene, s_name AS name, round(1 - 2 * (qy * qy + qz * qz), 6) AS r00, round(2 * (qx * qy - qw * qz), 6) AS r01, round(2 * (qx * qz - qw * qy), 6) AS r20, round(tx, 6) AS tx, round(tz, 6) AS tz
FROM cam JOIN supplier ON i = s_suppkey""")
def sink_frames_json(s, d):
    path = work_path(s, "frames")
    sinks.sink_frames_json(_cameras(s, d), path)
    f = F.from_json("value", "struct<frames:array<struct<file_path:string,transform_matrix:array<array<double>>>>>")
    x = s.read.text(path).select("scene", F.explode(f["frames"]).alias("f")).select("scene", "f.*")
    m = lambda r, c: F.col("transform_matrix")[r][c]
    return rounded(x.select(F.col("scene").cast("long").alias("scene"), F.col("file_path").alias("name"), m(0, 0).alias("r00"), m(0, 1).alias("r01"), m(2, 0).alias("r20"), m(0, 3).alias("tx"), m(2, 3).alias("tz")))


@query("SELECT id, sha1('base|' || run || '|' || id) AS key FROM metrics")
def content_key(s, d):
    return reuse.content_key(view(s, d, "metrics"), ["run", "id"], "base").select("id", "key")


@query("SELECT id, id * 2 AS doubled FROM metrics WHERE id % 2 = 0 OR id % 3 = 0")
def reuse_results(s, d):
    """Two requests: the second computes only what the first did not."""
    path = work_path(s, "store")
    m = view(s, d, "metrics").select("id", F.col("id").cast("string").alias("key"))
    twice = lambda x: x.withColumn("doubled", F.col("id") * 2)
    reuse.reuse_results(m.where("id % 2 = 0"), path, twice)
    return reuse.reuse_results(m.where("id % 2 = 0 or id % 3 = 0"), path, twice).select("id", "doubled")


# A stream reads folders or patterns; the pattern [e]vents names the one table.
def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Everything a stream emits over the files that are there."""
    s = stream.sparkSession
    out = work_path(s, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query("""WITH x AS (SELECT date_trunc('day', ts) AS start, worker FROM metrics), n AS (SELECT start, worker, count(*) AS n FROM x GROUP BY start, worker)
SELECT start, worker, n FROM n WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM metrics)""")
def stream_worker_throughput(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("worker"))
    return _drained(jobs.stream_worker_throughput(e, late="1 hour"), "throughput").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DISTINCT a.conv_id AS sequence, a.turn AS i, b.turn AS j FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 2""")
def stream_sequential_pairs(s, d):
    schema = s.read.parquet(f"{d}/conversations.parquet").schema
    f = s.readStream.schema(schema).parquet(f"{d}/[c]onversations.parquet").select(F.col("conv_id").alias("sequence"), F.col("turn").alias("i"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drained(jobs.stream_sequential_pairs(f, 2), "frame-pairs")
    finally:
        s.conf.set(key, before)
