"""Candidate pairs: which images to compare."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.ranking import numbered
from lensframe.session import task_count

#: Keypoint pairs that a task of ``match_mutual_nn`` takes.
TASK_PAIRS = 500_000


#: Rows of a block when all pairs are made. Spark holds the pairs of two blocks at a time.
BLOCK_ROWS = 512
#: Blocks travel by so many that they make up at most so many groups, up to so many in a group.
GROUPS, MOST_BLOCKS = 64, 16


def block_cells(rows: DataFrame, item: Column, block: int) -> DataFrame:
    """b, c, m, n: rows are numbered by i and cut into groups of whole blocks; every two groups b <= c
    are dealt to as many tasks as there are such pairs (at most 4 096), so the quadratic result is
    spread evenly however few bytes it comes from, and is made without a join of rows. Groups keep a
    row from travelling once for every block; where they arrive they are cut, so m and n are the
    lists of the items of two blocks."""
    placed = numbered(rows, [], ["i"])
    n = placed.count()
    size = max(1, min(block * min(MOST_BLOCKS, -(-n // (block * GROUPS))), -(-n // 4)))
    groups = max(1, -(-n // size))
    lists = placed.withColumn("b", F.expr(f"int(number div {size})")).groupBy("b").agg(F.collect_list(item).alias("m"))
    left = lists.withColumn("c", F.explode(F.sequence("b", F.lit(groups - 1))))
    cells = left.join(lists.select(F.col("b").alias("c"), F.col("m").alias("n")).hint("merge"), "c")
    # A number of its own: else small inputs are put together in one task.
    cells = cells.repartition(min(4096, groups * (groups + 1) // 2), "b", "c")

    def cut(c: str) -> Column:
        return F.explode_outer(F.transform(F.sequence(F.lit(0), ((F.size(c) - 1) / block).cast("int")), lambda k: F.slice(c, k * block + 1, block))).alias(c)

    return cells.select("b", "c", cut("m"), "n").select("b", "c", "m", cut("n"))


def pairs_exhaustive(images: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """All i < j, made from pairs of blocks."""
    cells = block_cells(images.select("i").where("i is not null").distinct(), F.col("i"), block)
    return cells.select(F.explode("m").alias("i"), "n").select("i", F.explode("n").alias("j")).where("i < j")


def pairs_sequential(frames: DataFrame, lookahead: int, key: str | None = None) -> DataFrame:
    """i < j <= i + lookahead within a sequence, as an equi join on the offset."""
    keys = [key] if key else []
    a = frames.select(*keys, "i").distinct()
    ahead = a.withColumn("j", F.explode(F.expr(f"transform(sequence(1, {int(lookahead)}), x -> i + x)")))
    return ahead.join(a.select(*keys, F.col("i").alias("j")), [*keys, "j"], "left_semi").select(*keys, "i", "j")


def pairs_similarity(vectors: DataFrame, k: int, min_score: float, group_rows: int = 4096) -> DataFrame:
    """For every i the k best j > i by dot product, scores below ``min_score``
    dropped (equal kept), ties to the smaller j.

    Block join: vectors fall into P blocks by hash; a cell is a pair of blocks,
    so each vector goes to P cells and a cell's product is one matrix multiply.
    Each cell keeps its own k best per i before the merge, so what is shuffled
    back is at most k P rows per vector, and no matrix of all pairs exists."""
    n = vectors.count()
    blocks = max(1, -(-n // group_rows))
    v = vectors.select("i", F.col("vec").cast("array<double>").alias("vec")).where("i is not null and vec is not null")
    v = v.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = v.withColumn("o", other).select(
        F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "i", "vec")

    def cell(key, t):
        x, y = (c.as_py() for c in key)
        ids, b = t.column("i").to_numpy(), t.column("b").to_numpy()
        m = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p, q in {(x, y), (y, x)}:
            r, c = np.flatnonzero(b == p), np.flatnonzero(b == q)
            for s in range(0, len(r), 512):
                rr = r[s : s + 512]
                score = m[rr] @ m[c].T
                ok = (score >= min_score) & (ids[c][None, :] > ids[rr][:, None])
                if len(c) > k:  # only what comes near a row's k-th best is sorted
                    score[~ok] = -np.inf
                    ok &= score >= np.partition(score, len(c) - k, axis=1)[:, len(c) - k, None] - 1e-8
                a, z = np.nonzero(ok)
                w = score[a, z]
                order = np.lexsort((ids[c][z], -np.round(w, 9), a))
                a, z, w = a[order], z[order], w[order]
                first = np.searchsorted(a, a, "left")
                keep = np.arange(len(a)) - first < k
                out.append((ids[rr][a[keep]], ids[c][z[keep]], w[keep]))
        i, j, w = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"i": i.astype(np.int64), "j": j.astype(np.int64), "score": w})

    best = rows.groupBy("x", "y").applyInArrow(cell, "i long, j long, score double")
    # The score is rounded for the ranking so that the order of additions in a
    # product cannot decide a tie.
    w = Window.partitionBy("i").orderBy(F.desc(F.round("score", 9)), "j")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("i", "j", "score")


def pair_window_filter(pairs: DataFrame, lookahead: int) -> DataFrame:
    return pairs.where((F.col("i") < F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= lookahead))


def pairs_joint(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("i", "j")
    for p in parts[1:]:
        out = out.union(p.select("i", "j"))
    return out.distinct()


def match_mutual_nn(a: DataFrame, b: DataFrame, keys: list[str], ratio: float | None = None) -> DataFrame:
    """Mutual nearest neighbours of the keypoints (k, desc) of two images, per
    ``keys`` (the image pair); with a ratio test d1 <= ratio * d2 if asked for.
    Keypoints of one image pair are bounded by the detector; tasks grow in number with
    the keypoint pairs, not in size."""
    sizes = a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys)
    tasks = task_count(a.sparkSession, sizes.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0, TASK_PAIRS)
    d = F.sqrt(F.aggregate(F.zip_with("da", "db", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    p = a.select(*keys, F.col("k").alias("k1"), F.col("desc").alias("da")).repartition(tasks, *keys).hint("merge").join(
        b.select(*keys, F.col("k").alias("k2"), F.col("desc").alias("db")).repartition(tasks, *keys), keys).withColumn("d", d)
    one = Window.partitionBy(*keys, "k1").orderBy("d", "k2")
    two = Window.partitionBy(*keys, "k2").orderBy("d", "k1")
    p = p.withColumns({"r1": F.row_number().over(one), "next": F.lead("d").over(one), "r2": F.row_number().over(two)})
    p = p.where("r1 = 1 and r2 = 1")
    if ratio is not None:
        p = p.where(F.col("next").isNull() | (F.col("d") <= ratio * F.col("next")))
    return p.select(*keys, "k1", "k2", "d")


def hamming(a: str, b: str):
    """Differing bits of two binary descriptors held as long words."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def edge_attr_join(attrs: DataFrame, edges: DataFrame) -> DataFrame:
    return attrs.join(edges.select("i", "j").distinct(), ["i", "j"], "left_semi")


def edge_outliers(edges: DataFrame, inliers: DataFrame) -> DataFrame:
    return edges.join(inliers.select("i", "j").distinct(), ["i", "j"], "left_anti")


def two_view_inputs(pairs: DataFrame, images: DataFrame, priors: DataFrame) -> DataFrame:
    """Pairs with both images' columns and, where there is one, the pose prior."""
    one = images.select([F.col(c).alias(c if c == "i" else f"{c}_i") for c in images.columns])
    two = images.select([F.col(c).alias("j" if c == "i" else f"{c}_j") for c in images.columns])
    return pairs.join(one, "i").join(two, "j").join(priors, ["i", "j"], "left")


def valid_edge_filter(edges: DataFrame, rotations: DataFrame, directions: DataFrame) -> DataFrame:
    """Edges i < j for which both a rotation and a direction are known."""
    ok = edges.where("i < j")
    for t, c in ((rotations, "rotation"), (directions, "direction")):
        ok = ok.join(t.where(F.col(c).isNotNull()).select("i", "j"), ["i", "j"], "left_semi")
    return ok


def inlier_support(reports: DataFrame, min_inliers: int, min_ratio: float, strict: bool = False) -> DataFrame:
    """Why a pair fails: too low a ratio, or too few inliers. A pair without any
    inlier passes the count test unless ``strict`` (kept behaviour)."""
    few = F.col("n_inliers") < min_inliers
    if not strict:
        few = few & (F.col("n_inliers") > 0)
    return reports.withColumn("failure", F.when(F.col("ratio") < min_ratio, "ratio").when(few, "inliers"))


def bridge_topk(cross: DataFrame, island: str, k: int) -> DataFrame:
    w = Window.partitionBy(island).orderBy(F.desc("score"), "i", "j")
    return cross.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def rig_predicted_pairs(constraints: DataFrame, minimum: int = 30) -> DataFrame:
    """(a, b, counts: 5x5) -> image pairs (5 a + x, 5 b + y) with enough matches."""
    x = constraints.select("a", "b", F.posexplode("counts").alias("x", "row")).select("a", "b", "x", F.posexplode("row").alias("y", "n"))
    return x.where(F.col("n") >= minimum).select((F.col("a") * 5 + F.col("x")).alias("i"), (F.col("b") * 5 + F.col("y")).alias("j"), "n")


def rig_priors(poses: DataFrame, pairs: DataFrame, rig: int = 5, hub: int = 2) -> DataFrame:
    """i, j, type, q, t: relative pose priors of the given image pairs and of star edges from
    the hub camera of every rig to its other cameras. Pairs within a rig are HARD, pairs
    across rigs SOFT; image index = rig * size + camera. q and t are the pose of i seen
    from j; a pair with an image of unknown pose (i, q, t) has no prior."""
    p = poses.where("q is not null and t is not null").select("i", "q", "t")
    rig_of = lambda c: F.floor(F.col(c) / rig)
    others = F.filter(F.sequence(F.lit(0), F.lit(rig - 1)), lambda k: k != hub)
    star = p.select(rig_of("i").cast("long").alias("g")).distinct().withColumn("k", F.explode(others))
    star = star.select((F.col("g") * rig + hub).alias("i"), (F.col("g") * rig + F.col("k")).alias("j"))
    both = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).unionByName(star).distinct()
    one = p.select("i", F.col("q").alias("_q1"), F.col("t").alias("_t1"))
    two = p.select(F.col("i").alias("j"), F.col("q").alias("_q2"), F.col("t").alias("_t2"))
    r = both.join(one, "i").join(two, "j")
    r = g.bound(g.bound(r, "q", g.multiply(g.conjugate(F.col("_q2")), F.col("_q1"))), "t", g.rotate(g.conjugate(F.col("_q2")), g.sub(F.col("_t1"), F.col("_t2"))))
    return r.select("i", "j", F.when(rig_of("i") == rig_of("j"), "HARD").otherwise("SOFT").alias("type"), "q", "t")


def match_count_weight(matches: DataFrame) -> DataFrame:
    return matches.groupBy("i", "j").agg(F.count("*").alias("weight"))
