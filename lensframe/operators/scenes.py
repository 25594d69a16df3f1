"""Whole-scene operators: filters, alignment, clusters and clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.functions import geometry as g
from lensframe.operators.ranking import numbered, percentiles
from lensframe.session import discard, materialise


def inspect_tracks(errors: DataFrame, limit: float) -> DataFrame:
    """Per track: what is wrong with its measurements (depth, error, failed)."""
    return errors.groupBy("track_id").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("depth") < 0), F.lit(False)).alias("behind"),
        F.coalesce(F.bool_or(F.col("err") > limit), F.lit(False)).alias("far"), F.count_if(F.col("err").isNull()).alias("failed"), F.max("err").alias("worst"))


def staged_filter(errors: DataFrame, limits: list[float]) -> DataFrame:
    """Tracks that survive each limit; every stage starts from the whole data."""
    worst = errors.groupBy("track_id").agg(F.max("err").alias("worst"), F.count_if(F.col("err").isNull()).alias("failed"))
    s = worst.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    return s.groupBy("limit").agg(F.count_if((F.col("failed") == 0) & (F.col("worst") < F.col("limit"))).alias("kept"), F.count("*").alias("tracks"))


def filter_landmarks(errors: DataFrame, limit: float) -> DataFrame:
    """Measurements of the tracks that have only errors below the limit; the errors are worked out once."""
    ok = F.bool_and(F.col("err").isNotNull() & (F.col("err") < limit)).over(Window.partitionBy("track_id"))
    return errors.where("track_id is not null").withColumn("_ok", ok).where("_ok").drop("_ok")


def filter_measurements(errors: DataFrame, limit: float, least: int) -> DataFrame:
    """Measurements within the limit of the tracks that ``least`` cameras see by such."""
    kept = errors.where(F.col("track_id").isNotNull() & F.col("err").isNotNull() & (F.col("err") <= limit))
    w = Window.partitionBy("track_id")
    n = F.max("_at").over(w) - F.max(F.col("i").isNull().cast("int")).over(w)
    return kept.withColumn("_at", F.dense_rank().over(w.orderBy("i"))).withColumn("_n", n).where(F.col("_n") >= least).drop("_at", "_n")


def drop_outlier_tracks(errors: DataFrame, most: float = 5.0, factor: float = 5.0, scope: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Tracks of mean error at most min(most, factor * median of the means), within
    each ``scope``. A mean at the cut can depend on the order of its additions: by ``order``,
    a column that tells a track's rows apart, they are added in that order."""
    by, mean = [*scope, "track_id"], F.avg("err")
    if order:
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        errors, mean = errors.withColumn("_mean", mean.over(upto)), F.max_by("_mean", order)
    m = errors.groupBy(*by).agg(mean.alias("mean_err"))
    cut = percentiles(m, list(scope), F.col("mean_err"), {"median": 0.5}).select(*scope, F.least(F.lit(most), factor * F.col("median")).alias("cut"))
    met = m.join(cut, list(scope)) if scope else m.crossJoin(cut)  # without a scope the cut is one row
    return met.where(F.col("mean_err") <= F.col("cut")).drop("cut")


def init_cameras(poses: DataFrame, intrinsics: DataFrame) -> DataFrame:
    return poses.where("q is not null and t is not null").join(intrinsics, "i")


def apply_sim3(rows: DataFrame, sims: DataFrame, key: str = "scene_id") -> DataFrame:
    """Points x, y, z moved by s (R p + t) of their scene."""
    j = rows.join(sims.select(key, F.col("s").alias("_s"), F.col("q").alias("_q"), F.col("t").alias("_t")), key)
    p = g.scale(g.add(g.rotate(F.col("_q"), g.vec(F.col("x"), F.col("y"), F.col("z"))), F.col("_t")), F.col("_s"))
    return j.withColumn("_p", p).withColumns({c: F.col(f"_p.{c}") for c in "xyz"}).drop("_s", "_q", "_t", "_p")


def _umeyama(n, ma, mb, cov, var):
    import numpy as np

    u, d, vt = np.linalg.svd(np.array(cov).reshape(3, 3) / n)
    s = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        s[2] = -1
    r = u @ np.diag(s) @ vt
    scale = float((d * s).sum() / var) if var > 1e-12 else 1.0
    t = np.array(mb) - scale * r @ np.array(ma)
    w = np.sqrt(max(0.0, 1 + r[0, 0] + r[1, 1] + r[2, 2])) / 2
    if w > 1e-6:
        q = [w, (r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w)]
    else:
        v = np.linalg.eigh(r + r.T)[1][:, -1]
        q = [0.0, *v]
    return scale, [float(x) for x in q], [float(x) for x in t / scale]


def estimate_sim3(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b point structs) -> s, q, t with b = s (R a + t), least squares:
    fifteen moments per group on the executors, one small SVD per group."""
    n = "xyz"
    a, b = F.col("a"), F.col("b")
    first = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a[c]).alias(f"ma{c}") for c in n), *(F.avg(b[c]).alias(f"mb{c}") for c in n))
    c = pairs.join(first, keys)
    second = c.groupBy(*keys).agg(
        F.first("n").alias("n"), F.array(*(F.first(f"ma{x}") for x in n)).alias("ma"), F.array(*(F.first(f"mb{x}") for x in n)).alias("mb"),
        F.array(*(F.sum((b[p] - F.col(f"mb{p}")) * (a[q] - F.col(f"ma{q}"))) for p in n for q in n)).alias("cov"),
        F.avg(sum(((a[x] - F.col(f"ma{x}")) ** 2 for x in n[1:]), (a["x"] - F.col("max")) ** 2)).alias("var"))
    kind = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.DoubleType()))])
    solve = F.udf(_umeyama, kind)  # one row per group
    r = second.withColumn("r", solve("n", "ma", "mb", "cov", "var"))
    return r.select(*keys, "n", F.col("r.s").alias("s"), g.quat(*(F.col("r.q")[i] for i in range(4))).alias("q"), g.vec(*(F.col("r.t")[i] for i in range(3))).alias("t"))


def normalise_poses(cameras: DataFrame, key: str = "scene_id") -> DataFrame:
    """Centres on the scene's mean position, largest coordinate 1."""
    m = cameras.groupBy(key).agg(*(F.avg(F.col("t")[c]).alias(f"m{c}") for c in "xyz"))
    c = cameras.join(m, key).withColumn("t", g.vec(*(F.col("t")[x] - F.col(f"m{x}") for x in "xyz"))).drop("mx", "my", "mz")
    s = c.groupBy(key).agg(F.max(F.greatest(*(F.abs(F.col("t")[x]) for x in "xyz"))).alias("_s"))
    return c.join(s, key).withColumn("t", g.scale(F.col("t"), 1 / F.nullif("_s", F.lit(0.0)))).drop("_s")


def frustum_vertices(cameras: DataFrame, depth: float) -> DataFrame:
    """Camera centre and the four image corners at ``depth``, in the world."""
    p = F.col("params")
    rows = [F.struct(F.lit(0).alias("vertex"), F.col("t").alias("p"))]
    for n, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1):
        ray = g.vec((F.col("width") * a - p[2]) / p[0] * depth, (F.col("height") * b - p[3]) / p[1] * depth, F.lit(float(depth)))
        rows.append(F.struct(F.lit(n).alias("vertex"), g.add(g.rotate(F.col("q"), ray), F.col("t")).alias("p")))
    return cameras.select("i", F.explode(F.array(*rows)).alias("r")).select("i", "r.vertex", "r.p.*")


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One mean point per voxel; all points if the size is not positive."""
    if size <= 0:
        return points.select("x", "y", "z", F.lit(1).cast("long").alias("n"))
    c = [F.floor(F.col(a) / size).alias(f"v{a}") for a in "xyz"]
    return points.groupBy(*c).agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n")).select("x", "y", "z", "n")


def robust_center(points: DataFrame, p: float = 0.75) -> DataFrame:
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    cut = percentiles(points, [], n, {"cut": p})
    return points.join(F.broadcast(cut), n < F.col("cut")).agg(*(F.avg(c).alias(c) for c in "xyz"))


def near_camera_points(points: DataFrame, cameras: DataFrame, radius: float, levels: int = 5) -> DataFrame:
    """Points strictly within ``radius`` of a camera. Occupied cells of points and cameras are
    compared first, from cells of that size down to its 2^levels-th part: a cell of points that
    lies wholly within the radius of a camera cell is settled, and of the camera cells
    only those stay that may hold the nearest camera. What no cell settles meets those
    cameras' rows. So the work follows the cells at the border, not points times cameras.
    Rows with a null or non-finite coordinate are near nothing."""
    key = {s: [f"_{s}{n}" for n in "xyz"] for s in "pc"}
    xyz = {"p": [F.col(n) for n in "xyz"], "c": [F.col("_t")[n] for n in "xyz"]}
    up = lambda n, by: F.expr(f"shiftright({n}, {by})")

    def celled(t, s):
        fit = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in xyz[s]]
        return t.where(fit[0] & fit[1] & fit[2]).withColumns({k: F.floor(c / (radius / 2**levels)).cast("long") for k, c in zip(key[s], xyz[s])})

    def occupied(s, level):
        """The cells of a level, each with its parent's place."""
        by = levels - level
        return cells[s].select(*(up(n, by).alias(n) for n in key[s]), *(up(n, by + 1).alias(f"u{n}") for n in key[s])).distinct().hint("merge")

    p, c = celled(points, "p"), celled(cameras.select(F.col("t").alias("_t")).distinct(), "c")
    cells = {s: materialise(t.select(*key[s]).distinct(), "near-cells") for s, t in (("p", p), ("c", c))}
    pairs, inside, rounds = None, None, []
    # Merge joins all along: the planner can't see how many rows a cell holds.
    for level in range(levels + 1):
        h = radius / 2**level
        if pairs is None:
            pairs = occupied("c", 0).select(*key["c"])
            for n, k in zip(key["p"], key["c"]):
                pairs = pairs.withColumn(n, F.explode(F.sequence(F.col(k) - 2, F.col(k) + 2)))
            pairs = pairs.select(*key["p"], *key["c"]).join(occupied("p", 0).select(*key["p"]), key["p"])
        else:
            pairs = pairs.select(*(F.col(n).alias(f"u{n}") for s in "pc" for n in key[s]))
            for s in "pc":
                pairs = pairs.join(occupied(s, level), [f"u{n}" for n in key[s]])
        # Cells count as a little larger than they are, so that rounding never decides.
        slack = h * (1e-6 + 1e-12 * F.greatest(*(F.abs(F.col(n)) for s in "pc" for n in key[s])))
        apart = [F.abs(F.col(m) - F.col(n)) for m, n in zip(key["p"], key["c"])]
        length = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        pairs = pairs.select(*key["p"], *key["c"], length([F.greatest((d - 1) * h - slack, F.lit(0.0)) for d in apart]).alias("_lo"), length([(d + 1) * h + slack for d in apart]).alias("_hi"))
        pairs = pairs.where(F.col("_lo") < radius).withColumn("_least", F.min("_hi").over(Window.partitionBy(*key["p"])))
        rounds.append(materialise(pairs.where(F.col("_lo") <= F.col("_least")).drop("_lo", "_hi"), "near-pairs"))
        found = rounds[-1].where(F.col("_least") < radius).select(F.lit(level).alias("_l"), *key["p"]).distinct()
        inside = found if inside is None else inside.unionByName(found)
        pairs = rounds[-1].where(F.col("_least") >= radius).drop("_least")
    tests = materialise(pairs.join(c.hint("merge"), key["c"]).select(*key["p"], "_t"), "near-tests")
    above = cells["p"].withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({f"u{n}": up(n, f"{levels} - _l") for n in key["p"]})
    full = above.join(inside.withColumnsRenamed({n: f"u{n}" for n in key["p"]}).hint("merge"), ["_l", *(f"u{n}" for n in key["p"])], "left_semi")
    full = materialise(full.select(*key["p"]).distinct(), "near-full")
    discard(*rounds, *cells.values())
    d2 = sum(((F.col(n) - F.col("_t")[n]) ** 2 for n in "yz"), (F.col("x") - F.col("_t")["x"]) ** 2)
    some = p.join(tests.hint("merge"), [*(p[n] == tests[n] for n in key["p"]), d2 < radius * radius], "left_semi")
    return p.join(full.hint("merge"), key["p"], "left_semi").unionByName(some).select(*points.columns)


#: Cells along a block's edge, and the most neighbours and points of a block that one task call takes.
BLOCK_CELLS, BLOCK_OTHERS, BLOCK_POINTS = 6, 60_000, 20_000


def _nearest(k: int):
    """Cogroup function: for the points of a block the k best of its neighbours."""
    import numpy as np
    import pyarrow as pa

    def run(_, p, o):
        n, m = p.num_rows, o.num_rows
        ids, other = (t.column(c).to_numpy() for t, c in ((p, "id"), (o, "other")))
        at = [p.column(c).to_numpy() for c in "xyz"]
        to = [o.column(f"b{c}").to_numpy() for c in "xyz"]
        order = np.argsort(other, kind="stable")  # so that a stable sort by distance breaks ties by id
        other, to = other[order], [t[order] for t in to]
        out, step = [], max(1, 200_000 // max(m, 1))
        for s in range(0, n if m else 0, step):
            d = np.zeros((min(step, n - s), m))
            for x, y in zip(at, to):
                d += (x[s : s + step, None] - y[None, :]) ** 2
            d = np.sqrt(d)
            d[ids[s : s + step, None] == other[None, :]] = np.nan  # comes last
            if m > k:
                bound = np.partition(d, k - 1, 1)[:, k - 1 : k]
                row, col = np.nonzero((d <= bound) | (np.isnan(bound) & ~np.isnan(d)))
            else:
                row, col = np.nonzero(~np.isnan(d))
            w = d[row, col]
            by = np.lexsort((col, w, row))
            row, col, w = row[by], col[by], w[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            out.append((ids[s : s + step][row[keep]], other[col[keep]], w[keep]))
        i, j, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": i.astype(np.int64), "other": j.astype(np.int64), "d": d})

    return run


def knn_points(points: DataFrame, others: DataFrame, k: int, size: float) -> DataFrame:
    """(id, other, d, rank) of the k nearest others (another id), ties to the smaller
    one; all of them where there are fewer. Grid search: a point is settled once its k-th
    distance is within the ring searched; the cell grows for those that are not, until
    it spans both clouds, so every point is settled. The first cell is ``size`` or,
    if that is less, what holds about k others at the mean density of their middle
    (96 % along each axis, so that far points don't widen it). Rows
    with a null or non-finite coordinate take no part.

    A block of cells gets its own points and the others up to one cell around it; a block
    with many of either is dealt to several tasks. Of the others at one place only those
    of the k + 1 smallest ids can be among the k nearest, so copies cost no more."""
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz")
    kinds = {n: dict(t.dtypes)["id"] for n, t in (("id", points), ("other", others))}
    xyz = lambda t, n, p="": t.where(ok).select(F.col("id").cast("long").alias(n), *(F.col(c).cast("double").alias(f"{p}{c}") for c in "xyz"))
    todo = xyz(points, "id").where("id is not null")
    place = Window.partitionBy("bx", "by", "bz").orderBy("other")
    others = materialise(xyz(others, "other", "b").where("other is not null").withColumn("_r", F.dense_rank().over(place)).where(F.col("_r") <= k + 1).drop("_r"), "knn-others")
    ends = lambda t, p: t.agg(F.count("*").alias("n"), *(f(f"{p}{c}").alias(f"{a}{c}") for c in "xyz" for a, f in (("lo", F.min), ("hi", F.max))),
                              *(F.percentile_approx(f"{p}{c}", F.array(F.lit(0.02), F.lit(0.98)), F.lit(1000)).alias(f"mid{c}") for c in "xyz")).first()
    both, own = ends(others, "b"), ends(todo, "")
    typed = lambda t: t.select(F.col("id").cast(kinds["id"]).alias("id"), F.col("other").cast(kinds["other"]).alias("other"), "d", "rank")
    if not both.n or not own.n:
        return typed(todo.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")))
    span = max(*(max(both[f"hi{c}"], own[f"hi{c}"]) - min(both[f"lo{c}"], own[f"lo{c}"]) for c in "xyz"), size)
    mid = [max(both[f"mid{c}"][1] - both[f"mid{c}"][0], 1e-9) for c in "xyz"]
    r = max(min(size, (mid[0] * mid[1] * mid[2] * k / both.n) ** (1 / 3)), span / 2**20)
    out, rounds, block = None, 0, ["cx", "cy", "cz"]
    while True:
        edge = r * BLOCK_CELLS
        cell = lambda c, off=0.0: F.floor((F.col(c) + off) / edge).cast("long")  # noqa: B023, E731
        a = todo.select("*", *(cell(c).alias(f"c{c}") for c in "xyz"))
        b = others
        for c in "xyz":  # a little more than a cell, so that rounding leaves none out
            b = b.withColumn(f"c{c}", F.explode(F.sequence(cell(f"b{c}", -1.001 * r), cell(f"b{c}", 1.001 * r))))  # noqa: B023
        parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
        # Merge joins: the planner can't see how many rows an explode makes or a block holds.
        sizes = a.groupBy(*block).agg(F.count("*").alias("_n")).join(b.groupBy(*block).agg(F.count("*").alias("_m")).hint("merge"), block)
        sizes = materialise(sizes.select(*block, parts("_n", BLOCK_POINTS).alias("_p"), parts("_m", BLOCK_OTHERS).alias("_o")), "knn-blocks")

        def dealt(t, key, mine, theirs):
            """Rows of a block in as many parts as it has, each met by every part of the other side."""
            t = t.join(sizes.hint("merge"), block).withColumn(mine, F.pmod(F.xxhash64(key), F.col(mine)).cast("int"))  # noqa: B023
            return t.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).groupBy(*block, "_p", "_o")

        near = dealt(a, "id", "_p", "_o").cogroup(dealt(b, "other", "_o", "_p")).applyInArrow(_nearest(k), "id long, other long, d double")
        w = Window.partitionBy("id")
        near = near.withColumn("rank", F.row_number().over(w.orderBy("d", "other"))).where(F.col("rank") <= k)
        last = r >= span
        done = near if last else near.withColumns({"_m": F.max("rank").over(w), "_d": F.max("d").over(w)}).where((F.col("_m") == k) & (F.col("_d") <= r))
        done = materialise(done.select("id", "other", "d", "rank"), "knn")
        out = done if out is None else out.unionByName(done)
        left = None if last else materialise(todo.join(done.where("rank = 1").select("id").hint("merge"), "id", "left_anti"), "knn-todo")
        discard(sizes, *([todo] if rounds else []))
        if last or left.isEmpty():
            discard(others)
            return typed(out)
        todo, rounds = left, rounds + 1
        r = min(r * (2 if rounds < 3 else 4), span)


def cloud_nn_distance(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    far = b.select((-F.col("id") - 1).alias("id"), "x", "y", "z")  # own names, so that a point may meet its twin
    return knn_points(a, far, 1, size).select("id", "d")


# -- clusters: a node is the path from the root ------------------------------
def cluster_binary(images: DataFrame, leaf_size: int) -> DataFrame:
    """Keys in order, halved (larger half second) to depth ceil(log2(n / leaf))."""
    r = materialise(numbered(images.select("i").distinct(), [], ["i"], "lo", "n"), "cluster-keys")
    n = r.agg(F.max("n")).first()[0] or 0
    depth, size = 0, leaf_size
    while size < n:
        depth, size = depth + 1, size * 2
    path = []
    for k in range(depth):
        half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
        right = (F.col("n") > 1) & (F.col("lo") >= half)
        r = r.withColumn(f"b{k}", right.cast("int"))
        r = r.withColumns({"lo": F.when(right, F.col("lo") - half).otherwise(F.col("lo")), "n": F.when(right, F.col("n") - half).otherwise(F.least("n", half))})
        path.append(f"b{k}")
    return r.select("i", (F.array(*path) if path else F.array().cast("array<int>")).alias("path"))


def edge_owner(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The node that owns an edge: the longest common prefix of its ends' paths."""
    c = clusters.select("i", "path")
    e = edges.select("i", "j").join(c.withColumnRenamed("path", "pi"), "i").join(c.select(F.col("i").alias("j"), F.col("path").alias("pj")), "j")
    same = F.transform(F.arrays_zip("pi", "pj"), lambda x, k: x["pi"] == x["pj"])
    first = F.array_position(same, F.lit(False))
    return e.select("i", "j", F.when(first == 0, F.col("pi")).otherwise(F.slice("pi", F.lit(1), (first - 1).cast("int"))).alias("owner"))


def cluster_annotations(clusters: DataFrame, annotations: DataFrame) -> DataFrame:
    """node, leaf and the columns of the annotations (i, j, ...) of the edges that each node owns:
    the whole payload of a leaf or of an inner node. Edges with an end outside the tree go."""
    owned = edge_owner(annotations.select("i", "j").distinct(), clusters)
    leaves = clusters.select(F.col("path").alias("owner"), F.lit(True).alias("leaf")).distinct()
    o = owned.join(leaves, "owner", "left").select("i", "j", F.col("owner").alias("node"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    return o.join(annotations, ["i", "j"])


def cluster_even_bins(images: DataFrame, bins: int) -> DataFrame:
    """Bins of equal size in key order; the first ones hold one key more."""
    r = numbered(images.select("i").distinct(), [], ["i"], "r", "n")
    less, more = F.floor(F.col("n") / bins), F.col("n") % bins
    full = more * (less + 1)
    b = F.when(F.col("r") < full, F.floor(F.col("r") / (less + 1))).otherwise(more + F.floor((F.col("r") - full) / F.greatest(less, F.lit(1))))
    return r.select("i", b.cast("int").alias("bin"))


def prefixes(path: str):
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.slice(F.col(path), F.lit(1), k))


def cluster_keys(clusters: DataFrame) -> DataFrame:
    """Keys in the subtree of every node."""
    return clusters.select(F.explode(prefixes("path")).alias("node"), "i").distinct()


def cluster_records(clusters: DataFrame) -> DataFrame:
    """node, parent, depth, keys in the node itself and in its subtree."""
    sub = cluster_keys(clusters).groupBy("node").agg(F.count("*").alias("subtree_keys"))
    own = clusters.groupBy(F.col("path").alias("node")).agg(F.countDistinct("i").alias("own_keys"))
    return sub.join(own, "node", "left").select(
        "node", F.when(F.size("node") > 0, F.slice("node", F.lit(1), F.size("node") - 1)).alias("parent"), F.size("node").alias("depth"),
        F.coalesce("own_keys", F.lit(0)).alias("own_keys"), "subtree_keys")


def tree_track_total(tracks: DataFrame) -> DataFrame:
    """Tracks summed over every subtree; ``tracks`` has (path, n)."""
    return tracks.select(F.explode(prefixes("path")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))


def cluster_prune(nodes: DataFrame, data: DataFrame) -> DataFrame:
    """Nodes with data of their own or below them."""
    live = data.select(F.explode(prefixes("path")).alias("path")).distinct()
    return nodes.join(live, "path", "left_semi")


def color_by_cluster(clusters: DataFrame) -> DataFrame:
    """A colour per path: the first bytes of its MD5."""
    h = F.md5(F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))))
    return clusters.select("path").distinct().select("path", *(F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")))
