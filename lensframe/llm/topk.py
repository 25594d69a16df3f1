"""Exact top-k search by a vector-approximation file.

Every vector is stored as small cells, one code per dimension on that dimension's
own marks: evenly spaced over the middle 99 % of a bounded sample, then ever wider
up to the exact least and largest component, so that a few far vectors don't widen
everybody's cells. For a query, the cells bound the inner product from both sides. Scan:
every (query block, vector block) pair is bounded from the codes alone; a vector
stays only if its upper bound reaches the k-th largest lower bound known for the
query. Read: the exact vectors of those that stay are visited in order of their
bounds (largest upper bound first, the inner product's reading of lower-bound
order of distances) until the k-th exact score is out of reach of the next bound.

The bounds are integers, so no score is lost to rounding; components so large that
a sum of products could pass 2**53 raise a ValueError. The query set is stated by
the caller and meets all rows in blocks.

Equal vectors are one class with its k + 1 smallest ids, which is all that any
query can need of them, so a vector that a third of the rows repeat is bounded
and read once.

Cases: vectors that are null, empty, or hold a null or non-finite component take
no part; vectors of another length than the query meet no query; a null vec_id
takes no part; equal rows count once; a vec_id with several vectors counts with
each, and asks with the smallest; a query never meets its own id; ties go to the
smaller vec_id; fewer than k others give fewer rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensframe.session import arrow_rows, materialise

from .textio import lean

SCALE = 256
BITS = 7  # at most 8: codes are bytes
K = 5
QUERY_BLOCK = 128
VECTOR_BLOCK = 16384
#: Components read to the driver to place the marks; they decide the cost, not the result.
SAMPLE_COMPONENTS = 1 << 20


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * component), valid vectors only."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0))
    return ok.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = K, bits: int = BITS, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` has vec_id and integer array
    v; ``is_query`` is a condition on vec_id."""
    rows = vectors.select("vec_id", "v").distinct()
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = (
        rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("cid"), "v", "ids", F.size("v").alias("d"))
    )
    classes = materialise(classes, "va-vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialise(queries.join(classes.select("v", "cid", "d"), "v").select(F.col("vec_id").alias("query_id"), "v", "cid", "d"), "va-queries")
    span = classes.groupBy("d").agg(F.count("*").alias("n")).collect()
    out = None  # span has a row per vector length
    for r in span:
        part = _one_length(classes.where(F.col("d") == r.d), queries.where(F.col("d") == r.d), k, bits, r, query_block, vector_block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _rows(b: pa.RecordBatch | pa.Table, column: str, dim: int) -> np.ndarray:
    c = b.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().reshape(-1, dim)


def _blocks(batches, rows: int):
    """Batches joined up to at least ``rows`` rows (the last one may be shorter)."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ends(classes: DataFrame, dim: int) -> np.ndarray:
    """The least and the largest component of each dimension."""

    def run(batches):
        for b in _blocks(batches, 8192):
            v = _rows(b, "v", dim)
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(v.min(0)), pa.array(v.max(0))], ["at", "lo", "hi"])

    got = classes.select("v").mapInArrow(lean(run), "at int, lo long, hi long").groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    got = got.sort_values("at")
    return np.stack([got["lo"].to_numpy(np.int64), got["hi"].to_numpy(np.int64)])


def marks_of(sample: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Marks of each dimension, one more than there are cells; cell c holds
    marks[c] .. marks[c + 1] - 1. The last eighth of the cells on either side
    doubles in width as far as it has to."""
    cells = 1 << bits
    tail = cells // 8
    out = np.empty((ends.shape[1], cells + 1), np.int64)
    for d, (lo, hi) in enumerate(ends.T.tolist()):
        a, b = (int(x) for x in np.quantile(sample[:, d], (0.005, 0.995)))
        a, b = max(lo, a), min(hi, b) + 1
        middle = a + (b - a) * np.arange(cells - 2 * tail + 1) // (cells - 2 * tail)
        grow = lambda reach: np.ceil(reach * (2.0 ** np.arange(1, tail + 1) - 1) / (2.0**tail - 1)).astype(np.int64)
        out[d] = np.concatenate([(a - np.minimum(grow(a - lo), a - lo))[::-1], middle, b + np.minimum(grow(hi + 1 - b), hi + 1 - b)])
    return out


def _one_length(classes: DataFrame, queries: DataFrame, k: int, bits: int, span, query_block: int, vector_block: int) -> DataFrame:
    dim = span.d
    ends = _ends(classes, dim)
    if (np.abs(ends.astype(np.float64)).max(0) ** 2).sum() >= 2.0**53:
        raise ValueError(f"components of vectors of length {dim} are too large for exact sums")
    share = max(1, -(-span.n * dim // SAMPLE_COMPONENTS))
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).select("v").limit(max(1, 2 * SAMPLE_COMPONENTS // dim)).toArrow()
    marks = marks_of(_rows(sample, "v", dim) if sample.num_rows else ends, ends, bits)

    def approximate(batches):  # the approximation file: class ids and one-byte codes of a block
        for b in _blocks(batches, vector_block):
            v, ids = _rows(b, "v", dim), b.column("cid").to_numpy()
            codes = np.stack([np.searchsorted(marks[d, 1:-1], v[:, d], "right") for d in range(dim)], axis=1).astype(np.uint8)
            for i in range(0, b.num_rows, vector_block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i : i + vector_block].tobytes()], pa.binary()) for x in (ids, codes)], ["ids", "codes"])

    def gather(batches):
        for b in _blocks(batches, query_block):
            cols = [b.column("query_id").to_numpy(), b.column("cid").to_numpy(), _rows(b, "v", dim).astype(np.int64)]
            for i in range(0, b.num_rows, query_block):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + query_block].tobytes()], pa.binary()) for x in cols], ["qids", "own", "qv"])

    def scan(batches):
        for b in batches:
            for qids, own, qv, ids, codes in zip(*(b.column(c).to_pylist() for c in ("qids", "own", "qv", "ids", "codes"))):
                q_id, q_own, c_id = (np.frombuffer(x, np.int64) for x in (qids, own, ids))
                q = np.frombuffer(qv, np.int64).reshape(-1, dim).astype(np.float64)
                c = np.frombuffer(codes, np.uint8).reshape(-1, dim)
                low, high = marks[dims, c].astype(np.float64), (marks[dims, c.astype(np.int64) + 1] - 1).astype(np.float64)
                plus, minus = np.maximum(q, 0), np.minimum(q, 0)
                upper = plus @ high.T + minus @ low.T  # sums of whole numbers below 2**53: exact
                lower = plus @ low.T + minus @ high.T
                lower[q_own[:, None] == c_id[None, :]] = -np.inf  # the own class may hold no other id
                reach = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(q_id), -np.inf)
                i, j = np.nonzero(upper >= reach[:, None])
                low_ij = lower[i, j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[i]), pa.array(c_id[j]), pa.array(np.where(np.isinf(low_ij), 0, low_ij).astype(np.int64), mask=np.isinf(low_ij)),
                     pa.array(upper[i, j].astype(np.int64))], ["query_id", "cid", "lower", "upper"])

    dims = np.arange(dim)[None, :]

    # Every query block goes to every group of vector blocks; a row is one block.
    # Vectors are dealt evenly first, so that a group is a few full blocks.
    groups = max(6, -(-span.n // (2 * vector_block)))
    va = classes.select("cid", "v").repartition(groups).mapInArrow(lean(approximate), "ids binary, codes binary")
    va = va.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    blocks = queries.select("query_id", "cid", "v").coalesce(4).mapInArrow(lean(gather), "qids binary, own binary, qv binary")
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    with arrow_rows(classes.sparkSession, 4):
        scanned = va.join(blocks, "g").mapInArrow(lean(scan), "query_id long, cid long, lower long, upper long")
        kept = materialise(scanned, "va-candidates")
    # The k-th largest lower bound over all blocks; a null one does not count.
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("lower"), "cid")
    reach = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id").agg(
        F.when(F.count("lower") == k, F.min("lower")).alias("reach"))
    kept = kept.join(reach, "query_id").where("reach is null or upper >= reach").select("query_id", "cid", "upper")
    pairs = kept.join(classes.select("cid", F.col("v").alias("x"), "ids"), "cid").join(
        queries.select("query_id", F.col("v").alias("q")), "query_id")

    def read(key, t):
        me = key[0].as_py()
        upper, ids = t.column("upper").to_numpy(), t.column("ids").to_pylist()
        x, q = _rows(t, "x", dim).astype(np.int64), _rows(t.slice(0, 1), "q", dim).astype(np.int64)[0]
        order, best = np.argsort(-upper, kind="stable"), []
        for i in range(0, len(order), 16):  # a few vectors at a time, in bound order
            if len(best) == k and upper[order[i]] < -best[-1][0]:
                break
            for c, s in zip(order[i : i + 16], x[order[i : i + 16]] @ q):
                best += [(-int(s), j) for j in ids[c] if j != me]
            best = sorted(best)[:k]
        return pa.table({
            "query_id": pa.array([me] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([j for _, j in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.int64())})

    return pairs.groupBy("query_id").applyInArrow(read, "query_id long, rank int, vec_id long, score long")
