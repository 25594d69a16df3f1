"""Alignment, merging, outliers and ranks against brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensframe.operators import alignment, dense, merging, outliers, ranking, scenes
from lensframe.plans import catalog_merge
from tests.compare import SF

RNG = np.random.default_rng(7)


def test_percentiles_and_numbers_equal_numpy(spark):
    """Ties, a hot group, null keys and values, NaN last, one row per group without values."""
    rows = [("hot", float(v)) for v in RNG.integers(0, 9, 3000)] + [(k, float(v)) for k in ("a", "b", None) for v in RNG.normal(size=17)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in ranking.percentiles(df, ["k"], F.col("v"), {"p0": 0.0, "p3": 0.3, "p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {"hot", "a", "b", None, "one"}
    for k, r in got.items():
        v = [x for key, x in rows if key == k and x is not None]
        assert np.allclose([r.p0, r.p3, r.p50, r.p100], np.percentile(v, [0, 30, 50, 100]))
    assert ranking.percentiles(df, [], F.col("v"), {"p": 0.5}).first().p == np.median([v for _, v in rows if v is not None])
    assert ranking.percentiles(df.limit(0), [], F.col("v"), {"p": 0.5}).first().p is None
    ids = df.where("v is not null").withColumn("id", F.monotonically_increasing_id())
    out = ranking.numbered(ids, ["k"], ["v", "id"], "n", "size").toPandas()
    for _, part in out.groupby("k", dropna=False):
        assert sorted(part.n) == list(range(len(part))) and set(part["size"]) == {len(part)}
        p = part.sort_values("n")
        assert list(zip(p.v, p.id)) == sorted(zip(part.v, part.id))


def test_even_bins_and_halves(spark):
    for n, bins in ((10, 3), (2, 5), (7, 7)):
        got = {r.i: r.bin for r in scenes.cluster_even_bins(spark.range(n).select(F.col("id").alias("i")), bins).collect()}
        assert [got[i] for i in range(n)] == [k for k, part in enumerate(np.array_split(np.arange(n), bins)) for _ in part]


def quaternion(axis, angle):
    a = np.array(axis) / np.linalg.norm(axis)
    return np.concatenate([[np.cos(angle / 2)], np.sin(angle / 2) * a])


def rotation(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
                     [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def times(a, b):
    w, x, y, z = a
    return np.array([[w, -x, -y, -z], [x, w, -z, y], [y, z, w, -x], [z, -y, x, w]]) @ b


POSES = "g long, i long, qa struct<w:double,x:double,y:double,z:double>, ta struct<x:double,y:double,z:double>, qb struct<w:double,x:double,y:double,z:double>, tb struct<x:double,y:double,z:double>"


def noisy_pairs(n=12, bad=5):
    """Poses under a similarity with a little noise, ``bad`` of them wrong."""
    s, q, t, out = 2.5, quaternion((1, 2, -1), 0.8), np.array([3.0, -1.0, 2.0]), []
    for i in range(n):
        qb, tb = quaternion(RNG.normal(size=3), RNG.uniform(0, 3)), RNG.normal(size=3) * 4
        qa, ta = times(quaternion(RNG.normal(size=3), 0.004), times(q, qb)), s * (rotation(q) @ tb + t) + RNG.normal(size=3) * 0.01
        if i < bad:
            qa, ta = quaternion(RNG.normal(size=3), RNG.uniform(1, 3)), RNG.normal(size=3) * 20
        out.append((qa, ta, qb, tb))
    return (s, q, t), out


def fit(pairs):
    d = np.array([times(a, b * [1, -1, -1, -1]) for a, _, b, _ in pairs])
    q = np.linalg.eigh(d.T @ d)[1][:, -1]
    a, b = np.array([p[1] for p in pairs]), np.array([p[3] for p in pairs])
    rb = (b - b.mean(0)) @ rotation(q).T
    s = ((a - a.mean(0)) * rb).sum() / (rb * rb).sum()
    return s, q * np.sign(q[0]), a.mean(0) / s - rotation(q) @ b.mean(0)


def auc5(sim, pairs):
    s, q, t = sim
    err = []
    for qa, ta, qb, tb in pairs:
        p, r = s * (rotation(q) @ tb + t), times(q, qb)
        turn = np.degrees(2 * np.arccos(np.clip(abs(qa @ r), 0, 1)))
        err.append(max(turn, np.degrees(np.arccos(np.clip(p @ ta / np.linalg.norm(p) / np.linalg.norm(ta), -1, 1)))))
    e = np.sort([x for x in err if x < 5])
    return (5 * len(e) - e.sum() + (e[-1] / 2 if len(e) else 0)) / len(pairs) / 5


def frame(spark, groups):
    rows = [(g, i, *(tuple(map(float, x)) for x in p)) for g, pairs in groups.items() for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, POSES)


def test_robust_alignment_equals_an_exhaustive_search(spark):
    """40 % wrong poses; a group of one pose gives nothing; drawn hypotheses also find the transform."""
    truth, pairs = noisy_pairs()
    got = alignment.estimate_sim3_robust(frame(spark, {1: pairs, 2: pairs[:1]}), ["g"]).collect()
    assert [r.g for r in got] == [1]
    every = [fit(pairs)] + [fit([pairs[i], pairs[j]]) for i in range(len(pairs)) for j in range(i)]
    assert abs(got[0].auc - max(auc5(h, pairs) for h in every)) < 1e-6
    best = max(every, key=lambda h: round(auc5(h, pairs), 9))
    assert np.allclose([got[0].s, *got[0].q, *got[0].t], [best[0], *best[1] * np.sign(best[1][0]), *best[2]], atol=1e-6)
    _, many = noisy_pairs(60, 24)
    r = alignment.estimate_sim3_robust(frame(spark, {1: many}), ["g"], most=100).first()
    assert abs(r.s / truth[0] - 1) < 0.05 and r.auc > 0.5
    z = alignment.estimate_sim3_ransac(frame(spark, {1: many}), ["g"], 0.3, most=100).first()
    assert z.inliers == 36 and abs(z.s / truth[0] - 1) < 0.01
    assert np.allclose([z.s, *z.q, *z.t], [x for p in fit(many[24:]) for x in np.atleast_1d(p)], atol=1e-6)


def brute_order(edges, nodes):
    """Greedy order by looking at every node each time."""
    come, go = np.zeros(nodes), np.zeros(nodes)
    e = [(a, b, w) if w >= 0 else (b, a, -w) for a, b, w in edges]
    for a, b, w in e:
        go[a] += w
        come[b] += w
    left, out = set(range(nodes)), []
    while left:
        free = [v for v in left if come[v] < 1e-8]
        v = min(free) if free else min(left, key=lambda v: (-round((go[v] + 1) / (come[v] + 1), 9), v))
        left.remove(v)
        out.append(v)
        for a, b, w in e:
            if a == v and b in left:
                come[b] -= w
            if b == v and a in left:
                go[a] -= w
    return out


def test_line_orders_of_many_directions_at_once():
    """Cycles, equal weights and single edges: every row as if by itself, with nodes that nothing runs into placed together."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 30, 90), rng.integers(0, 30, 90)
    a, b = np.append(a[a != b], [30, 3]), np.append(b[a != b], [4, 31])
    w = np.round(rng.uniform(-1, 1, (25, len(a))), 1) + 0.01
    got = outliers.line_orders(a, b, w, 32)
    for row, x in zip(got, w):
        place = np.argsort(brute_order([*zip(a.tolist(), b.tolist(), x.tolist())], 32))
        assert (row == np.where(x >= 0, place[a] > place[b], place[b] > place[a])).all()
    assert 0 < got.sum() < got.size / 2


def test_projection_outliers_equal_brute_force(spark):
    p = RNG.normal(size=(14, 3))
    pairs = [(a, b) for a in range(14) for b in range(14) if a < b or RNG.random() < 0.2 and a != b]
    unit = lambda v: v / np.linalg.norm(v)
    bad = set(map(tuple, np.array(pairs)[RNG.choice(len(pairs), 4, False)]))
    d = {e: unit(p[e[1]] - p[e[0]]) * (-1 if e in bad else 1) for e in pairs}
    marks = {(a, -1 - k): unit(RNG.normal(size=3)) for k, a in enumerate(range(0, 14, 3))}
    rows = [(5, a, b, tuple(map(float, v)), False) for (a, b), v in d.items()] + [(5, a, b, tuple(map(float, v)), True) for (a, b), v in marks.items()]
    edges = spark.createDataFrame(rows, "cluster long, a long, b long, direction struct<x:double,y:double,z:double>, landmark boolean")
    lines = [unit(v) for v in RNG.normal(size=(30, 3))]
    dirs = spark.createDataFrame([(5, k, *map(float, v)) for k, v in enumerate(lines)], "cluster long, d long, x double, y double, z double")
    names = sorted({v for e in (*d, *marks) for v in e})
    at = {v: k for k, v in enumerate(names)}
    want = {e: 0.0 for e in (*d, *marks)}
    for line in lines:
        w = {e: v @ line for e, v in {**d, **marks}.items()}
        place = {v: k for k, v in enumerate(brute_order([(at[a], at[b], x) for (a, b), x in w.items()], len(names)))}
        for (a, b), x in w.items():
            if (place[at[a]] > place[at[b]]) == (x >= 0):
                want[a, b] += abs(x) / len(lines)
    got = {(r.a, r.b): r.weight for r in outliers.projection_weights(edges, dirs, "cluster", 4).collect()}
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    kept = {(r.a, r.b) for r in outliers.projection_outliers(edges, dirs, "cluster", 0.125, 4).collect()}
    cams = {v for e in d if want[e] < 0.125 for v in e}
    assert kept == {e for e in d if want[e] < 0.125} | {e for e in marks if want[e] < 0.125 and e[0] in cams}
    assert bad.isdisjoint(kept) and len(kept & set(d)) >= len(d) - len(bad) - 4
    for how in ("uniform", "density"):
        r = outliers.direction_sample(edges, ["cluster"], 50, how).toPandas()
        assert len(r) == 50 and np.allclose(np.linalg.norm(r[["x", "y", "z"]], axis=1), 1)
    with pytest.raises(ValueError):
        outliers.direction_sample(edges, ["cluster"], 5, "other")


def test_overlap_points_equal_the_greedy_choice(spark):
    """The sequential choice over the sorted candidates."""
    obs = lambda: [(int(t), int(i), float(u), float(v)) for t, i, u, v in zip(RNG.integers(0, 12, 80), RNG.integers(0, 3, 80), RNG.integers(0, 4, 80), RNG.integers(0, 3, 80))]
    parent, child = obs(), obs()
    quality = {k: {t: (len([o for o in rows if o[0] == t]), float(RNG.integers(0, 40)) / 10) for t in {o[0] for o in rows}} for k, rows in (("p", parent), ("c", child))}
    shared = {}
    for t, i, u, v in parent:
        for t2, i2, u2, v2 in child:
            if (i, u, v) == (i2, u2, v2):
                shared[t, t2] = shared.get((t, t2), 0) + 1
    cand = []
    for c in {b for _, b in shared}:
        n, a = min((-k, a) for (a, b), k in shared.items() if b == c)
        cand.append((a, c, -n))
    order = lambda x: (-x[2], -(quality["p"][x[0]][0] + quality["c"][x[1]][0]), quality["p"][x[0]][1] + quality["c"][x[1]][1], x[1])
    used, one = set(), []
    for x in sorted(cand, key=order):
        if x[0] not in used:
            used.add(x[0])
            one.append(x)
    good = lambda k, t: quality[k][t][0] >= 3 and quality[k][t][1] < 2
    one.sort(key=lambda x: (not (good("p", x[0]) and good("c", x[1])), *order(x)))
    table = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "pair long, track_id long, i long, u double, v double")
    q = lambda k: spark.createDataFrame([(0, t, *x) for t, x in quality[k].items()], "pair long, track_id long, len long, err double")
    got = merging.scene_overlap_points(table(parent), table(child), q("p"), q("c"), ["pair"], most=5).orderBy("rank").collect()
    assert [(r.parent_track, r.child_track, r.shared) for r in got] == one[:5]


def test_tree_of_one_scene_and_unit_cube(spark):
    q, z = (1.0, 0.0, 0.0, 0.0), [1.0, 1.0, 0.0, 0.0]
    cams = spark.createDataFrame([([], 1, q, (0.0, 0.0, 0.0), "PINHOLE", z)], "path array<int>, i long, q struct<w:double,x:double,y:double,z:double>, t struct<x:double,y:double,z:double>, model string, params array<double>")
    pts = spark.createDataFrame([([], 1, 0.0, 0.0, 1.0)], "path array<int>, track_id long, x double, y double, z double")
    obs = spark.createDataFrame([([], 1, 1, 0.0, 0.0)], "path array<int>, track_id long, i long, u double, v double")
    c, p, o, n = merging.merge_tree(cams, pts, obs)
    assert (c.count(), p.count(), o.count(), n.count()) == (1, 1, 1, 0)
    c, p, o, n = merging.merge_tree(cams.limit(0), pts.limit(0), obs.limit(0))
    assert (c.count(), p.count(), o.count(), n.count()) == (0, 0, 0, 0)
    u = dense.unit_cube(spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 2.0, 0.0)], "x double, y double, z double")).first()
    assert (u.scale, u.ox, u.oy, u.oz) == (0.25, 0.0, 0.25, 0.5)


def test_merge_tree_nodes_moves_cameras_only(spark, monkeypatch):
    wrote, write = set(), merging.materialise
    monkeypatch.setattr(merging, "materialise", lambda df, name: (wrote.add(name), write(df, name))[1])
    t = catalog_merge.tree(spark, SF)
    row = lambda r: (tuple(r.path), r.ok, r.common, r.s and round(r.s, 9))
    got = sorted(row(r) for r in merging.merge_tree_nodes(t[0]).collect())
    assert len(got) == 7 and not wrote & {"tree-points", "tree-observations", "tree-kept"}
    assert got == sorted(row(r) for r in merging.merge_tree(*t)[3].collect())
