"""What would not fit at size: broadcasts of whole tables, tasks that hold a hot group, results that depend on how rows are split."""

import functools
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from lensframe.operators import graph, metrics, pairs, scenes, tracks
from lensframe.plans import catalog_merge, catalog_scene
from lensframe.plans.domain import cameras, view
from tests.compare import SF


def broadcasts(df) -> list[str]:
    """What a plan sends to every executor, each subtree as text."""
    plan, out = df._jdf.queryExecution().sparkPlan(), []

    def walk(p, sent):
        kids = p.children()
        left = p.toString()
        side = re.match(r"\w+", p.nodeName())[0] in ("BroadcastHashJoin", "BroadcastNestedLoopJoin") and ("BuildLeft" if re.search(r"BuildLeft", left.split("\n")[0]) else "BuildRight")
        for k in range(kids.size()):
            child = kids.apply(k)
            if side and k == (side == "BuildRight"):
                out.append(child.toString())
            walk(child, sent)

    walk(plan, False)
    return out


def test_axis_align_never_broadcasts_the_points(spark):
    """Spark takes exploded points for as small as the rows they come from."""
    assert not [b for b in broadcasts(catalog_merge.axis_align(spark, SF)) if "Generate" in b]


def test_neighbour_search_never_broadcasts(spark, monkeypatch):
    plans, write = [], scenes.materialise
    monkeypatch.setattr(scenes, "materialise", lambda df, name: (plans.extend(broadcasts(df)), write(df, name))[1])
    for q in (catalog_scene.knn_points, catalog_scene.cloud_nn_distance, catalog_merge.downsample_psnr):
        q(spark, SF)
    assert not plans


def test_neighbours_in_split_blocks_and_among_copies(spark, monkeypatch):
    """One place of many copies, ties, a far point; blocks are dealt to several tasks."""
    for name in ("BLOCK_OTHERS", "BLOCK_POINTS"):
        if hasattr(scenes, name):
            monkeypatch.setattr(scenes, name, 40)
    rng = np.random.default_rng(5)
    at = np.concatenate([np.zeros((150, 3)), rng.integers(0, 4, (150, 3)) / 2, rng.normal(size=(100, 3)), [[900.0, -7.0, 3.0]]])
    ids = rng.permutation(len(at)).tolist()
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in zip(ids, at)], "id long, x double, y double, z double").repartition(3)
    got = {(r["id"], r["rank"]): (r["other"], r["d"]) for r in scenes.knn_points(p, p, 4, 0.5).collect()}
    want = {}
    for i, x in zip(ids, at):
        d = sorted((float(np.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2)), j) for j, y in zip(ids, at) if j != i)
        want |= {(i, n + 1): (j, e) for n, (e, j) in enumerate(d[:4])}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_near_points_meet_few_cameras(spark, monkeypatch):
    """Points and cameras in one cell of the radius' size: the result is exact, and few cells meet a camera's rows."""
    written, write = {}, scenes.materialise
    monkeypatch.setattr(scenes, "materialise", lambda df, name: written.setdefault(name, write(df, name)) if name == "near-tests" else write(df, name))
    rng = np.random.default_rng(3)
    x, t = rng.uniform(-9, 9, (4000, 3)), rng.uniform(-2, 2, (1500, 3))
    x[0], x[1] = (np.nan, 0, 0), (-np.inf, 0, 0)
    p = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(x)], "id long, x double, y double, z double")
    c = spark.createDataFrame([(dict(zip("xyz", map(float, v))),) for v in t] + [(None,)], "t struct<x: double, y: double, z: double>")
    got = sorted(r.id for r in scenes.near_camera_points(p, c, 4.0).collect())
    d = ((x[:, None] - t[None]) ** 2).sum(2).min(1)
    assert got == np.flatnonzero(d < 16).tolist()
    assert written["near-tests"].count() < 4000 * 1500 / 50


def test_all_pairs_are_made_by_many_tasks(spark):
    """Few bytes make many rows, so the tasks must not be put together by bytes."""
    i = spark.range(2000).select(F.col("id").alias("i"))
    p = pairs.pairs_exhaustive(i, 200)
    assert p.rdd.getNumPartitions() >= 40
    per = p.groupBy(F.spark_partition_id()).count()
    assert per.agg(F.sum("count"), F.max("count")).first()[0] == 2000 * 1999 // 2 and per.agg(F.max("count")).first()[0] < 400_000
    assert p.where("i >= j").isEmpty() and p.distinct().count() == 2000 * 1999 // 2


def test_filters_work_errors_out_once(spark):
    """Rows of the errors are not made a second time to find the tracks."""
    from lensframe.plans.catalog_scene import filter_landmarks, filter_measurements, reprojection_error

    joins = lambda q: q(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(reprojection_error) == 2
    assert joins(filter_landmarks) == 2 and joins(filter_measurements) == 2


def test_robust_triangulation_numbers_long_tracks_only(spark, monkeypatch):
    """Short tracks' pairs come from one join on the track; both kinds of tracks are there once, short ones as before."""
    wrote, write = [], tracks.materialise
    monkeypatch.setattr(tracks, "materialise", lambda df, name: (wrote.append(name), write(df, name))[1])
    o, c = view(spark, SF, "obs").where("track_id < 300"), cameras(spark, SF)
    rows = lambda most: {r.track_id: (r.i1, r.i2, r.inliers) for r in tracks.track_triangulate_robust(o, c, 200.0, most).collect()}
    whole = rows(2749)
    assert "track-rays" not in wrote
    few = rows(6)
    assert "track-rays" in wrote and few.keys() == whole.keys()
    short = {r.track_id for r in o.join(c.select("i"), "i").groupBy("track_id").count().where("count <= 4").collect()}
    assert 0 < len(short & whole.keys()) < len(whole) and all(few[k] == whole[k] for k in short & whole.keys())


def most_rows_of_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_covisible_pairs_are_dealt_to_more_tasks(spark, monkeypatch):
    """Ten times the pairs are more tasks, not larger ones."""
    monkeypatch.setattr(graph, "TASK_PAIRS", 1000, raising=False)
    monkeypatch.setattr(graph, "TASK_ROWS", 500, raising=False)
    o = spark.range(4000).selectExpr("id div 4 as track_id", "(id * 7919) % 3001 as i")
    e = graph.covis_edges(o)
    assert e.rdd.getNumPartitions() == 6 and most_rows_of_a_task(e) < 1500 and e.count() <= 6000


def test_scene_lcc_ties_cameras_to_a_tracks_first(spark, monkeypatch):
    """A long track gives as many edges as measurements; lone cameras are components."""
    seen, lcc = [], graph.largest_component
    monkeypatch.setattr(graph, "largest_component", lambda e: (seen.append(e.count()), lcc(e))[1])
    o = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 500), (2, 501), (3, 900), (4, 199), (4, 300)], "track_id long, i long")
    assert sorted({r.track_id for r in graph.scene_lcc(o).collect()}) == [1, 4]
    assert seen[0] <= o.count()
    assert [r.i for r in graph.scene_lcc(spark.createDataFrame([(1, 7), (2, 5)], "track_id long, i long")).collect()] == [5]


def test_keypoint_pairs_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 1000, raising=False)
    a = spark.range(1000).selectExpr("id % 100 as i", "id as k", "array(double(id), double(id % 7)) as desc")
    m = pairs.match_mutual_nn(a, a, ["i"])
    assert m.rdd.getNumPartitions() == 10 and m.where("k1 <> k2").isEmpty() and m.count() == 1000


def test_similar_pairs_of_equal_scores(spark):
    """Scores that tie but for the order of additions go to the smaller j within a block, too."""
    v = [[0.1 * (n % 3), 0.7, 0.1 * ((n + 1) % 3)] for n in range(60)]
    v[7] = [0.0, 0.7 + 1e-11, 0.1]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(v)], "i long, vec array<double>")
    got = {(r.i, r.j) for r in pairs.pairs_similarity(df, 3, 0.1).collect()}
    want = {(a, b) for a in range(60) for b in sorted(range(a + 1, 60), key=lambda b: (-round(float(np.dot(v[a], v[b])), 9), b))[:3]}
    assert got == want


def test_relative_errors_of_all_pairs_join_no_pairs(spark):
    """The same as by joins; no join above the blocks of cameras, and two blocks make a bounded number of rows."""
    rng = np.random.default_rng(8)
    pose = lambda n: [(k, tuple(map(float, q)), tuple(map(float, t))) for k, q, t in zip(range(0, 3 * n, 3), rng.normal(size=(n, 4)), rng.normal(size=(n, 3)))]
    ref, est = pose(90), pose(90)[5:]
    ref[7], est[9] = (ref[7][0], None, ref[7][2]), (est[9][0], est[9][1], None)
    schema = "i long, q struct<w: double, x: double, y: double, z: double>, t struct<x: double, y: double, z: double>"
    a, b = (spark.createDataFrame(r, schema) for r in (ref, est))
    want = {(r.i, r.j): r[2:] for r in metrics.relative_pose_errs(pairs.pairs_exhaustive(a, 20), a, b).collect()}
    near = lambda x, y: (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    for directions in (True, False):
        got = metrics.relative_pose_errs_all(a, b, directions, 20).collect()
        assert len(got) == len(want) == 90 * 89 // 2
        assert not [(r, want[r.i, r.j]) for r in got if not all(map(near, r[2:], want[r.i, r.j]))]
    assert any(v[0] is None for v in want.values()) and any(v[0] is not None and v[1] is None for v in want.values())
    plan = catalog_scene.relative_pose_errs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan[: plan.index("Repartition")]
    cells = pairs.block_cells(spark.range(6000).select(F.col("id").alias("i")), F.col("i"), pairs.BLOCK_ROWS)
    assert cells.agg(F.max(F.size("m") * F.size("n"))).first()[0] < 500_000


def test_means_are_added_in_the_order_of_rows(spark):
    """A track whose mean is at the cut in some orders only; rows are dealt and turned round."""
    e = [1e16, 1.0, -1e16, 1.0]
    plain = lambda v: functools.reduce(float.__add__, v, 0.0)  # noqa: E731  (sum() makes up for rounding)
    orders = {plain(p) for p in itertools.permutations(e)}
    assert len(orders) > 1
    for p in ((0, 1, 2, 3), (0, 1, 3, 2), (0, 2, 1, 3), (3, 0, 1, 2)):
        rows = [(n, e[k]) for n, k in enumerate(p)]
        total = plain(x for _, x in rows)
        d = spark.createDataFrame([(1, n, x) for n, x in reversed(rows)], "track_id long, row long, err double").repartition(3)
        kept = scenes.drop_outlier_tracks(d, min(orders) / 4, 5.0, order="row").collect()
        assert [r.mean_err for r in kept] == ([total / 4] if total == min(orders) else [])


def test_all_pairs_take_little_disk(spark, tmp_path):
    """Pairs are made in runs that files hold in few bytes, and a row travels for a bounded number of blocks."""
    i = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("i"))
    pairs.pairs_exhaustive(i).write.parquet(str(tmp_path / "all"))
    size = sum(f.stat().st_size for f in (tmp_path / "all").iterdir())
    assert size < 0.5 * 3000 * 2999 / 2
    assert pairs.pairs_exhaustive(i, 16).distinct().count() == 3000 * 2999 // 2  # lists cut into slices
    cells = pairs.block_cells(spark.range(9000).select(F.col("id").alias("i")), F.col("i"), 32)
    n = cells.agg(F.count_distinct("b", "c"), F.max(F.size("m") * F.size("n")), F.sum(F.size("m") * F.size("n").cast("long"))).first()
    assert n[0] < 4096 and n[1] <= 32 * 32 and n[2] >= 9000 * 9000 / 2


def test_relative_pose_errs_has_both_errors(spark):
    """The query gives the error of the direction, too; two cameras in one place have none, but a rotation."""
    rows = catalog_scene.relative_pose_errs(spark, SF).collect()
    assert sum(r.direction_err is not None for r in rows) == sum(r.rotation_err is not None for r in rows) > 0
    assert len({r.direction_err for r in rows}) > 5
    schema = "i long, q struct<w: double, x: double, y: double, z: double>, t struct<x: double, y: double, z: double>"
    c = 2**-0.5
    a = spark.createDataFrame([(1, (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), (2, (c, 0.0, 0.0, c), (0.0, 0.0, 0.0)), (3, (1.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0))], schema)
    b = spark.createDataFrame([(1, (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), (2, (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0)), (3, (c, 0.0, 0.0, -c), (c, 0.0, 0.0))], schema)
    want = {(1, 2): (90.0, None), (1, 3): (90.0, 90.0), (2, 3): (0.0, float(np.degrees(np.arctan(c))))}
    near = lambda x, y: (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    joined = metrics.relative_pose_errs(pairs.pairs_exhaustive(a, 20), a, b).collect()
    for got in (joined, metrics.relative_pose_errs_all(a, b, True, 20).collect()):
        assert {(r.i, r.j) for r in got} == want.keys()
        assert not [(r, want[r.i, r.j]) for r in got if not all(map(near, r[2:], want[r.i, r.j]))]
