"""Readers over files cut into blocks, and writers whose lines are bounded."""

import json

from pyspark.sql import functions as F

from lensframe.operators import ranking
from lensframe.operators.reuse import reuse_results
from lensframe.sources import sinks, text_model


def test_records_of_a_file_read_in_many_blocks(spark, tmp_path):
    """Comments and empty point lines; two scenes; every block is shorter than a record."""
    for scene, n in (("one", 60), ("two", 7)):
        (tmp_path / scene).mkdir()
        lines = ["# images"]
        for k in range(n):
            lines += [f"{k + 1} 1 0 0 0 {k} 2 3 5 im{n - k:03d}.png", "" if k % 3 == 0 else " ".join(f"{k}.5 {j} {j - 1}" for j in range(k % 4))]
            if k % 5 == 0:
                lines.append("# a comment")
        (tmp_path / scene / "images.txt").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "150b")
    try:
        t = text_model.src_images(spark, str(tmp_path)).cache()
        rows, points = t.collect(), text_model.src_image_points(t).count()
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 67
    for scene, n in (("one", 60), ("two", 7)):
        mine = {r.image_id: r for r in rows if r.scene.endswith(scene)}
        assert sorted(mine) == list(range(1, n + 1))
        for k, r in mine.items():
            assert r.name == f"im{n - k + 1:03d}.png" and r.i == n - k and r.t.x == -(k - 1) and r.camera_id == 5
    assert points == sum(k % 4 for n in (60, 7) for k in range(n) if k % 3)


def test_lines_of_json_are_bounded(spark, tmp_path):
    rows = spark.range(2500).coalesce(1).select(F.lit("r").alias("run"), F.lit("g").alias("grp"), F.when(F.col("id") < 2400, "hot").otherwise("rare").alias("metric"), F.col("id").cast("double").alias("value"))
    sinks.sink_metrics_json(rows, str(tmp_path / "m"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert max(len(v["full_data"]) for x in lines for m in x.values() for v in m.values()) <= sinks.LINE_ROWS and len(lines) >= 3
    back = text_model.src_metrics_json(spark, str(tmp_path / "m"), "part-*", lines=True)
    assert sorted((r.metric, r.value) for r in back.collect()) == sorted((r.metric, r.value) for r in rows.select("metric", "value").collect())
    frames = spark.range(2100).coalesce(1).select(F.lit(1).alias("scene"), F.concat(F.lit("f"), "id").alias("name"), F.struct(*(F.lit(v).alias(k) for k, v in (("w", 1.0), ("x", 0.0), ("y", 0.0), ("z", 0.0)))).alias("q"),
                                                  F.struct(*(F.col("id").cast("double").alias(k) for k in "xyz")).alias("t"))
    sinks.sink_frames_json(frames, str(tmp_path / "f"))
    docs = [json.loads(r.value)["frames"] for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert max(map(len, docs)) <= sinks.LINE_ROWS and sorted(x["file_path"] for d in docs for x in d) == sorted(f"f{k}" for k in range(2100))


def test_reuse_computes_a_shared_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v int")
    out = reuse_results(rows, str(tmp_path / "store"), lambda d: d.withColumn("w", F.col("v") * 2))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 2), ("b", 2, 4)]
    again = reuse_results(rows, str(tmp_path / "store"), lambda d: d.withColumn("w", F.col("v") * 0))
    assert sorted(map(tuple, again.collect())) == [("a", 1, 2), ("b", 2, 4)]


def test_points_are_written_in_the_scenes_that_measure_them(spark, tmp_path):
    """Points need no scene of their own; the query reads each line once."""
    from lensframe.plans import catalog_io
    from tests.compare import SF

    o = spark.createDataFrame([("a", 1, 7, 0.5, 1.0), ("a", 2, 7, 0.5, 1.0), ("b", 3, 7, 2.0, 1.0), ("b", 3, 6, 9.0, 1.0), ("b", 4, 8, 0.0, 0.0)], "scene string, i long, track_id long, u double, v double")
    p = spark.createDataFrame([(7, 1.5, 2.0, 3.0, 1, 2, 3, 0.5), (6, 4.0, 5.0, 6.0, 4, 5, 6, 0.5), (5, 0.0, 0.0, 0.0, 0, 0, 0, 0.5)], "track_id long, x double, y double, z double, r int, g int, b int, error double")
    sinks.sink_points(p, o, str(tmp_path / "p"))
    t = text_model.src_tracks(text_model.src_points(spark, str(tmp_path / "p"), "part-*"), "x")
    assert sorted((r.scene[-1], r.point_id, r.image_id, r.k, r.x) for r in t.collect()) == [("a", 7, 1, 0, 1.5), ("a", 7, 2, 0, 1.5), ("b", 6, 3, 0, 4.0), ("b", 7, 3, 1, 1.5)]
    assert "Join " not in catalog_io.src_points(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_point_lines_are_not_written_to_rank_names(spark, tmp_path, monkeypatch):
    """Lines are numbered where they are read and names ranked among poses; poses meet measurements without a join."""
    wrote, write = [], ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name: (wrote.extend(df.columns), write(df, name))[1])
    pose = [(k, k, f"im{9 - k}", (1.0, 0.0, 0.0, 0.0), (float(k), 0.0, 0.0)) for k in range(4)]
    im = spark.createDataFrame(pose, "i long, camera_id long, name string, q struct<w: double, x: double, y: double, z: double>, t struct<x: double, y: double, z: double>").withColumn("scene", F.col("i") % 2)
    o = spark.createDataFrame([(0, 0, 5, 1.0, 2.0), (0, 0, 3, 4.0, 8.0), (1, 3, 5, 1.0, 2.0), (1, 8, 5, 1.0, 2.0)], "scene long, i long, track_id long, u double, v double")
    assert "Join " not in sinks.scene_lines(im, o)._jdf.queryExecution().optimizedPlan().toString()
    sinks.sink_images(im, o, str(tmp_path / "p"))
    t = text_model.src_images(spark, str(tmp_path / "p"), "part-*")
    assert sorted((r.image_id, r.name, r.i, r.t.x) for r in t.collect()) == [(0, "im9", 1, 0.0), (1, "im8", 1, 1.0), (2, "im7", 0, 2.0), (3, "im6", 0, 3.0)]
    assert sorted((r.image_id, r.k, r.u, r.point_id) for r in text_model.src_image_points(t).collect()) == [(0, 0, 4.0, 3), (0, 1, 1.0, 5), (3, 0, 1.0, 5)]
    assert wrote and not {"f", "line", "points"} & set(wrote)
