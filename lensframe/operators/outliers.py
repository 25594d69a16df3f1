"""Edges whose directions do not agree with an order of the nodes on a line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.functions import geometry as g
from lensframe.operators.ranking import numbered

MOST_DIRECTIONS = 2000
LIMIT = 0.125
#: Directions that a cluster's task takes before there is another one, up to ``batches``.
DIRECTIONS = 64
#: Edges times directions that are ordered at once.
STATES = 1 << 19
_TINY = 1e-8


def direction_sample(edges: DataFrame, keys: list[str], most: int = MOST_DIRECTIONS, how: str = "input", seed: int = 0) -> DataFrame:
    """keys, d, x, y, z: up to ``most`` unit directions per group, numbered from 0. "input" takes
    edge directions in a seeded hash order; "uniform" draws them from the sphere; "density"
    takes edge directions with replacement and turns each a little."""
    if how not in ("input", "uniform", "density"):
        raise ValueError(f"unknown way to sample directions: {how}")
    hashed = lambda *c: F.xxhash64(F.lit(seed), *c)
    # Two hashes give a point of the sphere: its height and its angle.
    part = lambda *c: F.pmod(hashed(*c), F.lit(1 << 52)) / float(1 << 52)
    if how == "input":
        e = edges.select(*keys, "a", "b", "direction").withColumn("_h", hashed("a", "b"))
        d = numbered(e, keys, ["_h", "a", "b"], "d").where(F.col("d") < most)
        return d.select(*keys, "d", *(F.col("direction")[c].alias(c) for c in "xyz"))
    groups = edges.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = groups.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    z, a = 2 * part(F.lit("z"), "d", *keys) - 1, 2 * np.pi * part(F.lit("a"), "d", *keys)
    r = F.sqrt(1 - z * z)
    d = g.bound(d, "_v", g.vec(r * F.cos(a), r * F.sin(a), z))
    if how == "density":
        e = numbered(edges.select(*keys, "a", "b", "direction"), keys, ["a", "b"], "_e")
        d = d.withColumn("_e", F.pmod(hashed(F.lit("e"), "d", *keys), F.col("_n"))).join(e.select(*keys, "_e", "direction"), [*keys, "_e"])
        d = g.bound(d, "_w", g.add(F.col("direction"), g.scale(F.col("_v"), F.lit(0.05)))).drop("_v")
        d = d.withColumn("_v", g.unit(F.col("_w")))
    return d.select(*keys, "d", *(F.col("_v")[c].alias(c) for c in "xyz"))


def line_orders(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Which edges run against an order of the nodes that few and light edges run against, for
    every row of ``weight`` (a direction) at once. The next node is always one with no weight
    coming in, else that with the largest (out + 1) / (in + 1) to nine places, the smaller
    node among equals. Edges run from a to b where the weight is positive.

    A node with no weight coming in has all its edges behind it, whatever came first among such
    nodes, so all of them are placed in one step; only the others are picked one by one."""
    rows, m = weight.shape
    flip = weight < 0
    src, dst, w = np.where(flip, b, a), np.where(flip, a, b), np.abs(weight)
    at = (np.arange(rows) * nodes)[:, None]
    src, dst, w = (src + at).ravel(), (dst + at).ravel(), w.ravel()
    size = rows * nodes
    ends = np.concatenate([src, dst])
    by = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by], np.arange(size + 1))
    by %= rows * m
    come, go = np.bincount(dst, w, size), np.bincount(src, w, size)
    place, step = np.full(size, -1), 0
    free = np.flatnonzero(come < _TINY)
    while True:
        if not len(free):
            left = (place < 0).reshape(rows, nodes)
            open_ = np.flatnonzero(left.any(1))
            if not len(open_):
                break
            ratio = np.round((go.reshape(rows, nodes)[open_] + 1) / (come.reshape(rows, nodes)[open_] + 1), 9)
            free = open_ * nodes + np.where(left[open_], ratio, -1.0).argmax(1)
        place[free] = step
        step += 1
        # All edges of the nodes just placed.
        count = first[free + 1] - first[free]
        e = by[np.repeat(first[free] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        out, into = e[place[dst[e]] < 0], e[place[src[e]] < 0]
        np.subtract.at(come, dst[out], w[out])
        np.subtract.at(go, src[into], w[into])
        near = np.unique(dst[out])
        free = near[come[near] < _TINY]
    return (place[src] > place[dst]).reshape(rows, m)


def projection_weights(edges: DataFrame, directions: DataFrame, key: str, batches: int = 16) -> DataFrame:
    """key, a, b, weight: the mean over a cluster's directions of how far an edge runs against
    the order found along the direction. ``edges`` (key, a, b, direction) are those of
    clusters of bounded size; a task takes one cluster and a share of its directions."""

    def run(k, e, d):
        if not e.num_rows or not d.num_rows:
            return pa.table({key: pa.array([], e.schema.field(key).type), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        a, b = e.column("a").to_numpy(), e.column("b").to_numpy()
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = flat[: len(a)], flat[len(a) :]
        unit = np.stack([e.column(c).to_numpy() for c in "xyz"], 1)
        total = np.zeros(len(a))
        lines = np.stack([d.column(c).to_numpy() for c in "xyz"], 1)
        share = max(1, STATES // len(a))
        for s in range(0, len(lines), share):
            w = lines[s : s + share] @ unit.T
            total += (np.abs(w) * line_orders(i, j, w, len(names))).sum(0)
        return pa.table({key: e.column(key), "a": a, "b": b, "w": total, "n": np.full(len(a), d.num_rows, np.int64)})

    kind = edges.schema[key].dataType.simpleString()
    # A cluster's edges go only to as many tasks as its directions fill.
    size = directions.groupBy(key).agg(F.least(F.lit(batches), F.ceil(F.count("*") / DIRECTIONS)).cast("int").alias("_k"))
    split = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_b")
    e = edges.join(size, key).select(key, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *(F.col("direction")[c].alias(c) for c in "xyz"), split)
    d = directions.join(size, key).select(key, *"xyz", F.pmod("d", F.col("_k")).cast("int").alias("_b"))
    parts = e.groupBy(key, "_b").cogroup(d.groupBy(key, "_b")).applyInArrow(run, f"{key} {kind}, a long, b long, w double, n long")
    return parts.groupBy(key, "a", "b").agg((F.sum("w") / F.sum("n")).alias("weight"))


def projection_outliers(edges: DataFrame, directions: DataFrame, key: str, limit: float = LIMIT, batches: int = 16) -> DataFrame:
    """The edges whose mean weight is below ``limit``, with it. Edges (key, a, b, direction,
    landmark) run from a camera to a camera, or to a landmark (its ids are other than the
    cameras'); a landmark's edge stays only if its camera has a camera edge that stays."""
    w = projection_weights(edges, directions, key, batches)
    kept = edges.join(w, [key, "a", "b"]).where(F.col("weight") < limit)
    cams = kept.where("not landmark").select(key, F.explode(F.array("a", "b")).alias("a")).distinct()
    return kept.where("not landmark").unionByName(kept.where("landmark").join(cams, [key, "a"], "left_semi").select(*kept.columns))
