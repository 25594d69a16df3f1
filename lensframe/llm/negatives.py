"""Hard negatives by a residue-number-system matrix product.

Anchors meet all rows in blocks. Every vector is kept as its residues modulo a few
primes below 256, one signed byte each. Two blocks are multiplied once per prime in
float32: a strip of dimensions is cut so short that no sum reaches 2**24, so each
product is an exact whole number, reduced modulo its prime. Chinese remaindering
(mixed radix, in 64-bit whole numbers) then gives the exact signed scores. As many
primes are taken as the largest possible score needs (Cauchy-Schwarz over the
data); scores that 100 times over do not fit 64 bits raise a ValueError.

A first pass keeps each anchor's best rows of its own label (the positives), a
second one, for each anchor and positive, the best rows of other labels whose score
lies in the window [low, high] (percent of the positive's score). A pair of blocks
passes on no more than the rows that can still be among the best; a window over
all blocks decides.

Cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component take no part; vectors of another length than the anchor's meet
it not; every row counts, equal ones and those of a repeated id too, and a row
is other than the anchor unless it is the very same row; ties go to the smaller id;
an anchor without positives, or a positive whose window is empty, gives no rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensframe.session import arrow_rows, materialise

from .textio import lean
from .topk import _blocks, _rows

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ANCHOR_BLOCK = 128
BLOCK_BYTES = 3 << 20
#: Whole numbers below this are exact in float32.
EXACT = 1 << 24
_PRIMES = [p for p in range(255, 190, -1) if all(p % q for q in range(2, 16))]


def labelled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v = floor(scale * component), of the rows that take part; a label
    of a row whose id is divisible by 7 is moved on by one (modulo 10)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = rows.where("vec_id is not null and label is not null and embedding is not null").where(~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0))
    ident, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return ok.select(ident.alias("vec_id"), F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                     F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("x"))


def primes_for(bound: int) -> list[int]:
    """The fewest of the primes whose product covers -bound .. bound."""
    out, product = [], 1
    for p in _PRIMES:
        if product > 2 * bound and len(out) > 1:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound or 100 * bound >= 1 << 63:
        raise ValueError(f"scores of up to {bound} do not fit 64 bits")
    return out


def residues(v: np.ndarray, primes: list[int]) -> np.ndarray:
    """Signed residues, one plane per prime."""
    out = np.empty((len(primes), *v.shape), np.int8)
    for k, p in enumerate(primes):
        r = v % p
        out[k] = np.where(r > p // 2, r - p, r)
    return out


def product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact a @ b.T as int64 from the residues of both."""
    x, base = np.zeros((a.shape[1], b.shape[1]), np.int64), 1
    for k, p in enumerate(primes):
        strip = (EXACT - 1) // (p // 2) ** 2
        r = np.zeros(x.shape, np.int64)
        for d in range(0, a.shape[2], strip):
            r += (a[k, :, d : d + strip].astype(np.float32) @ b[k, :, d : d + strip].astype(np.float32).T).astype(np.int64)
        x += base * ((r - x) % p * pow(base, -1, p) % p)
        base *= p
    return np.where(x > base // 2, x - base, x)


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the places ``at`` by score (largest first), then id."""
    if len(at) > 4 * k:
        s = score[at]
        at = at[s >= np.partition(s, -k)[-k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _packed(rows: DataFrame, names: list[str], dim: int, size: int, primes: list[int]) -> DataFrame:
    """Rows as blocks: each long column and the residues of v as bytes."""

    def run(batches):
        for b in _blocks(batches, size):
            cols = [b.column(c).to_numpy() for c in names]
            v = _rows(b, "x", dim).astype(np.int64)
            for i in range(0, b.num_rows, size):
                parts = [c[i : i + size].astype(np.int64).tobytes() for c in cols] + [residues(v[i : i + size], primes).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], [*names, "res"])

    return rows.select(*names, "x").mapInArrow(lean(run), ", ".join(f"{c} binary" for c in (*names, "res")))


def _unpacked(row: dict, names: list[str], dim: int, primes: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(row[c], np.int64) for c in names] + [np.frombuffer(row["res"], np.int8).reshape(len(primes), -1, dim)]


def _one_length(rows: DataFrame, anchors: DataFrame, dim: int, count: int, bound: int, positives: int, negatives: int, low: int, high: int, anchor_block: int) -> DataFrame:
    primes = primes_for(bound)
    size = max(1, min(16384, BLOCK_BYTES // (dim * len(primes))))
    groups = max(6, -(-count // (2 * size)))
    names = ["rid", "vec_id", "label"]
    theirs = [f"a_{c}" for c in names]
    blocks = _packed(rows.repartition(groups), names, dim, size, primes).withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int"))

    def meet(asking: DataFrame, extra: list[str], run, schema: str) -> DataFrame:
        """Every block of anchors with every block of rows."""
        asked = _packed(asking.coalesce(4), [*names, *extra], dim, anchor_block, primes)
        asked = asked.select(*(F.col(c).alias(f"a_{c}") for c in (*names, *extra, "res")), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

        def task(batches):
            for b in batches:
                for row in b.to_pylist():
                    ask = _unpacked({c: row[f"a_{c}"] for c in (*names, *extra, "res")}, [*names, *extra], dim, primes)
                    have = _unpacked(row, names, dim, primes)
                    yield run(ask[:-1], have[:-1], product(ask[-1], have[-1], primes))

        return blocks.join(asked, "g").drop("g").mapInArrow(lean(task), schema)

    def same_label(ask, have, score):
        out = []
        for i, (rid, ident, label) in enumerate(zip(*ask)):
            at = np.flatnonzero((have[2] == label) & (have[0] != rid))
            out += [(rid, ident, have[1][j], score[i, j]) for j in _best(score[i], have[1], at, positives)]
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "anchor_id", "positive_id", "positive_score"])

    near = meet(anchors, [], same_label, "rid long, anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= positives)
    near = materialise(near, "rns-positives")
    # An anchor travels once, with its positives side by side.
    places = range(1, positives + 1)
    own = lambda k, c: F.coalesce(F.max(F.when(F.col("place") == k, F.col(c))), F.lit(0)).cast("long")
    beside = near.groupBy("rid").agg(F.count("*").alias("found"), *(own(k, c).alias(f"{c}_{k}") for c in ("positive_id", "positive_score") for k in places))
    asking = beside.join(anchors, "rid")

    def in_window(ask, have, score):
        out = []
        for i, (rid, ident, label, n, *rest) in enumerate(zip(*ask)):
            s, other = score[i], have[2] != label
            for place, pos, ps in zip(range(1, n + 1), rest[:positives], rest[positives:]):
                at = np.flatnonzero(other & (low * ps <= 100 * s) & (100 * s <= high * ps))
                out += [(rid, place, ident, pos, ps, have[1][j], s[j]) for j in _best(s, have[1], at, negatives)]
        cols = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], found)

    found = ["rid", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    more = ["found", *(f"{c}_{k}" for c in ("positive_id", "positive_score") for k in places)]
    far = meet(asking, more, in_window, ", ".join(f"{c} long" for c in found))
    w = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``vectors`` has vec_id, label and x, whole numbers as doubles; ``is_anchor`` is a
    condition on vec_id."""
    spark = vectors.sparkSession
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "x"), "rns-vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("sq")).collect()  # a row per vector length
    anchors = rows.where(is_anchor)
    out = None
    with arrow_rows(spark, 4):
        for r in lengths:
            if not r.sq < 2.0**62:
                raise ValueError(f"vectors of length {r.d} are too large for 64-bit scores")
            bound = math.ceil(r.sq * (1 + 1e-9)) + 1
            own = F.size("x") == r.d
            part = _one_length(rows.where(own), anchors.where(own), r.d, r.n, bound, positives, negatives, low, high, anchor_block)
            part = materialise(part, "rns-negatives")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
