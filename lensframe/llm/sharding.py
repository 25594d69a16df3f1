"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts lie together.
Splitters that cut the order into parts of equal bytes are found without
sorting: every round counts, on all rows, the exact bytes and rows below a set
of probe keys (a task adds them up in a table as long as the probes) and narrows
the bracket of each splitter, until the bytes below it are within ``tolerance``
of the wanted share. Then the rows are exchanged once and sorted in place.

A group of equal texts is cut only where it alone exceeds the tolerance, then
between its doc_ids; rows of one doc_id are cut by their row number, which is
written with the rows once, so that it stays the same through all rounds.

Cases: a null text has no bytes (size 8) and counts as the empty text in the
order; a very long text is one row like others, so a shard holds at least it; a
null doc_id sorts first in its group; extra columns travel along, whatever their
names, except shard and slot, whose old values are dropped; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.session import discard, materialise

from .textio import fresh, lean

SHARDS = 24
#: Bytes that the parts of a splitter may be off, as a share of a part.
TOLERANCE = 0.002
#: Text bytes that one task sorts; larger shards are sorted in several parts.
PART_BYTES = 256 << 20
PROBES = 4096
_SIGN = 1 << 63


_BITS = 192


def _keys(*parts: np.ndarray) -> np.ndarray:
    """24-byte keys that compare as the (h, ident, row) of each row, all signed."""
    out = np.empty((len(parts[0]), 3), ">u8")
    for k, p in enumerate(parts):
        out[:, k] = p.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return out.view(f"S{_BITS // 8}").ravel()


def _as_keys(values: list[int]) -> np.ndarray:
    return np.array([v.to_bytes(_BITS // 8, "big") for v in values], f"S{_BITS // 8}")


def _below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)

    def run(batches):
        at = _as_keys(shared.value)
        size, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for b in batches:
            k = _keys(*(b.column(c).to_numpy() for c in ("h", "ident", "row")))
            s = b.column("size").to_numpy()
            p = np.searchsorted(at, k, "right")
            order = np.argsort(p, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(p[order]) > 0))) if len(p) else []
            if len(first):
                size[p[order][first]] += np.add.reduceat(s[order], first)
            rows += np.bincount(p, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(rows[full])], ["bucket", "size", "rows"])

    got = keys.mapInArrow(lean(run), "bucket int, size long, rows long").groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    size[got["bucket"]], rows[got["bucket"]] = got["size"], got["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, parts: int, total: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """Keys that cut (h, ident, row, size) rows into ``parts`` of near equal bytes,
    and the rows below each."""
    if parts < 2:
        return [], []
    each = max(4, PROBES // (parts - 1))
    want = [total * i // parts for i in range(1, parts)]
    slack = tolerance * total / parts
    lo, hi = [0] * (parts - 1), [1 << _BITS] * (parts - 1)
    best = [(float("inf"), 0, 0)] * (parts - 1)
    # First guess: hashed keys are spread evenly.
    probe = {i: [((i + 1) << _BITS) // parts + (j - each // 2) * ((1 << _BITS) // (parts * each)) for j in range(each)] for i in range(parts - 1)}
    while probe:
        flat = sorted({p for v in probe.values() for p in v if 0 < p < 1 << _BITS})
        size, rows = _below(keys, flat)
        for i in list(probe):
            k = int(np.searchsorted(size, want[i]))  # first probe with at least the wanted bytes below
            for c in (k - 1, k):
                if 0 <= c < len(flat):
                    best[i] = min(best[i], (abs(int(size[c]) - want[i]), flat[c], int(rows[c])))
            if k > 0:
                lo[i] = max(lo[i], flat[k - 1])
            if k < len(flat):
                hi[i] = min(hi[i], flat[k])
            if best[i][0] <= slack or hi[i] - lo[i] <= 1:
                del probe[i]
                continue
            width = hi[i] - lo[i]
            # Whole groups of equal texts first, then whole doc_ids, rows of one only at the end.
            unit = 1 << 128 if width > 1 << 129 else 1 << 64 if width > 1 << 65 else 1
            probe[i] = sorted({min(hi[i] - 1, max(lo[i] + 1, (lo[i] + width * j // (each + 1)) // unit * unit)) for j in range(1, each + 1)})
    order = sorted((b[1], b[2]) for b in best)
    return [k for k, _ in order], [r for _, r in order]


def histogram_sort(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``documents`` with shard and slot (its place in the shard, from 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    documents = documents.drop("shard", "slot")
    h, i, r, part = fresh(documents, "_h", "_i", "_r", "_p")
    keyed = documents.withColumns({
        h: F.xxhash64(text), i: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), r: F.monotonically_increasing_id()})
    keyed = materialise(keyed, "shard-rows")
    keys = keyed.select(F.col(h).alias("h"), F.col(i).alias("ident"), F.col(r).alias("row"), (F.octet_length(text) + 8).cast("long").alias("size"))
    keys = materialise(keys, "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, -(-total // (shards * part_bytes)))
    cut, rows = splitters(keys, shards * per, total, tolerance)
    discard(keys)
    shared = documents.sparkSession.sparkContext.broadcast(cut)

    @F.pandas_udf("int")
    def part_of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(_as_keys(shared.value), _keys(a.to_numpy(), b.to_numpy(), c.to_numpy()), "right").astype(np.int32))

    # Rows before each part within its shard.
    below = [0, *rows]
    offset = [below[p] - below[p // per * per] for p in range(shards * per)]
    placed = keyed.withColumn(part, part_of(h, i, r)).repartitionById(shards * per, F.col(part)).sortWithinPartitions(h, i, r)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("slot", row)
    if per > 1:
        placed = placed.withColumn("slot", F.col("slot") + F.element_at(F.array(*[F.lit(o) for o in offset]), F.col(part) + 1))
    return placed.withColumn("shard", F.floor(F.col(part) / per).cast("int")).drop(h, i, r, part)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of op9: size, checksum, shard and slot of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return histogram_sort(documents.select("doc_id", "text"), shards).select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
