"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles; two documents link when
``100 * |A & B| >= T * |A | B|``. Shingles are put in one global order, rare
ones first. Any l of two linked documents' common shingles that come first lie
within the first ``n - ceil(T n / 100) + l`` shingles of each, so a pair needs
only be looked at when its prefixes share l shingles. Every document picks the
l that minimises its own estimated cost (posting entries read plus candidates
to verify): a longer prefix, but more shared shingles demanded. A pair must
share ``min`` of its two l. Candidates are verified on the exact sets.

Rarity comes from a count of every distinct shingle of every document in a
fixed number of hash counters; a collision only shifts the order, never a result.

Common shingles of two documents that come before a common one in the order lie in
both prefixes. So a document's size without the shingles before that one that no
other prefix holds caps the overlap of any pair that meets there, and pairs whose
caps are below the overlap they need are never formed. Each set also has a sketch
of parities: two sets differ in at least as many shingles as their sketches differ
in bits, so pairs whose sketches differ too much are not formed either. Both tests
only turn away pairs that cannot link; they are what keeps a large group of copies
with many edits each from turning into all its pairs.

Equal sets are one node from the start. Linked groups are found without listing
all their pairs: in each star round every shared shingle compares its holders
with one pivot (the document with the fewest shingles of its own first, then by
hash), and the last round compares only holders outside a shingle's largest
component with the other ones. No bound is put on holders, partners or candidates.

Sets, nodes and shingles are compared by 64-bit hashes: results are exact but for
collisions of these.

Cases: null or blank texts have no shingles and link with nothing; a text of
fewer than k words is one shingle; a null doc_id is returned with a null
component; a doc_id that occurs on several rows joins the components of all its
texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensframe.operators.graph import connected_components
from lensframe.session import discard, materialise

from .textio import M1, WordHash, chunks, fresh, lean, mix, sharing, shingle_hashes, texts

SHINGLE_WORDS = 4
PERCENT = 85
SKETCH_BITS = 20
BLOCK = 1 << 14
#: Longest extension of a prefix.
MOST_MATCHES = 12
STAR_ROUNDS = 2
PARITY_WORDS = 8  # 64-bit words of a parity sketch
FILTER_BYTES = 4 << 20  # of an id filter
FILTER_BLOCK = 64 << 10


def shingle_set(text: bytes, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct shingles; words are runs of other than ASCII white space,
    A-Z lower-cased (what bytes.lower and bytes.split do)."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), k))


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _counters(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def profile(documents: DataFrame, k: int, bits: int) -> DataFrame:
    """One row per document (doc_id, n, node); and, with n null, each task's
    counts of shingles in blocks of hash counters."""

    def run(batches):
        hashes, total = WordHash(), np.zeros(1 << bits, np.uint32)
        for b in chunks(batches, "text"):
            n, node, all_h = [], [], []
            for t in texts(b, "text"):
                s = shingle_set(t, k, hashes)
                n.append(len(s))
                node.append(node_of(s))
                all_h.append(s)
            h = np.concatenate(all_h)
            total += np.bincount(_counters(h, bits), minlength=1 << bits).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                ["doc_id", "n", "node", "block", "counts"])
        if total.any():
            parts = total.reshape(-1, BLOCK)
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                 pa.array(np.arange(m), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["doc_id", "n", "node", "block", "counts"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lean(run), "doc_id long, n long, node long, block int, counts binary")


def sketch(rows: DataFrame, bits: int, fan: int = 12) -> np.ndarray:
    """Sum of all tasks' counters. Each level adds up a stream in one table of
    fixed size, so its memory does not depend on the number of tasks."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                v = np.frombuffer(c, np.uint32 if len(c) == 4 * BLOCK else np.uint64).astype(np.uint64)
                total[block] = total[block] + v if block in total else v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            ["block", "counts"])

    parts = rows.where("n is null and block is not null").select("block", "counts")
    parts = parts.repartition(fan).mapInArrow(lean(add), "block int, counts binary").repartition(1)
    out = np.zeros(1 << bits, np.uint64)
    for r in parts.mapInArrow(lean(add), "block int, counts binary").toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint64)
    return out


def choose_matches(held: np.ndarray, slack: int, most: int = MOST_MATCHES) -> int:
    """The l of least estimated cost for a document.

    ``held`` estimates, in prefix order, how many other documents hold each
    shingle. With l matches the prefix has slack + l shingles; reading their
    postings costs S = sum(held), and at most S / l pairs can share l of them,
    each verified against about len(held) shingles."""
    most = min(most, len(held) - slack)
    if most <= 1:
        return max(1, most)
    read = np.cumsum(held[: slack + most])[slack:]
    verify = 4 + len(held) / 8
    return int(np.argmin(read + verify * read / np.arange(1, most + 1))) + 1


def prefixes(documents: DataFrame, ranks, k: int, percent: int, bits: int) -> DataFrame:
    """(node, nl, tokens, s0, s1, ...): the shingles in each document's prefix,
    nl = 16 n + l, and its parity sketch; equal sets within a task give their row
    once. ``ranks`` is a broadcast of ``shingle_ranks``."""

    def run(batches):
        rank, mean = ranks.value
        hashes, seen = WordHash(), set()
        for b in chunks(batches, "text"):
            token, node, nl, odd = [], [], [], []
            for t in texts(b, "text"):
                s = shingle_set(t, k, hashes)
                if not len(s) or (v := node_of(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(v)
                r = rank[_counters(s, bits)]
                order = np.argsort(r, kind="stable")  # s is sorted: ties by hash
                slack = len(s) - -(-percent * len(s) // 100)
                held = np.maximum(np.exp2(r[order] / 1024.0) - 2 - mean, 0)
                m = choose_matches(held, slack)
                token.append(s[order[: slack + m]].view(np.int64))
                node.append(v)
                nl.append(len(s) * 16 + m)
                odd.append(parities(s))
            if token:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(nl, pa.int64()), _lists(token), *(pa.array(c) for c in np.stack(odd, axis=1))],
                    ["node", "nl", "tokens", *SKETCH])

    return documents.select(F.col("text").cast("string")).mapInArrow(lean(run), f"node long, nl long, tokens array<long>, {_SKETCH_KIND}")


def parities(s: np.ndarray) -> np.ndarray:
    """For each of the sketch's bits, whether an odd number of shingles falls on it."""
    bit = (s & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=64 * PARITY_WORDS).astype(np.uint8) & 1, bitorder="little").view(np.int64)


SKETCH = [f"s{i}" for i in range(PARITY_WORDS)]
_SKETCH_KIND = ", ".join(f"{c} long" for c in SKETCH)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def shingle_ranks(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Rarity of each counter in 1/1024 octaves (rare first) and the mean count."""
    return np.minimum(np.log2(counts + 1.0) * 1024, 65535).astype(np.uint16), float(counts.mean())


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit filter of fixed size of the ids (first column, long): says no only
    to ids that are not among them. Each task fills one filter; the filters are
    joined block by block on the executors."""

    def run(batches):
        f = np.zeros(FILTER_BYTES * 8, bool)
        for b in batches:
            for p in _places(b.column(0).to_numpy().view(np.uint64)):
                f[p] = True
        parts = np.packbits(f, bitorder="little").reshape(-1, FILTER_BLOCK)
        full = np.flatnonzero(parts.any(axis=1))
        yield _blocks_of(full.tolist(), [parts[i] for i in full])

    def join(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
                v = np.frombuffer(x, np.uint8)
                out[k] = out[k] | v if k in out else v
        yield _blocks_of(list(out), list(out.values()))

    kind = "block int, bits binary"
    rows = ids.select(F.col(ids.columns[0]).alias("id")).mapInArrow(lean(run), kind).repartition(8, "block").mapInArrow(lean(join), kind)
    got = rows.toArrow()  # at most FILTER_BYTES
    out = np.zeros(FILTER_BYTES, np.uint8)
    for k, x in zip(got.column("block").to_pylist(), got.column("bits").to_pylist()):
        out[k * FILTER_BLOCK : (k + 1) * FILTER_BLOCK] = np.frombuffer(x, np.uint8)
    return out


def _blocks_of(block: list[int], bits: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary())], ["block", "bits"])


def _places(u: np.ndarray) -> list[np.ndarray]:
    """The two filter bits of each id."""
    u = mix(u * M1)
    n = np.uint64(FILTER_BYTES * 8)
    return [(u % n).astype(np.int64), ((u >> np.uint64(20)) * M1 % n).astype(np.int64)]


def _maybe(flt: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = (flt[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in _places(ids.view(np.uint64)))
    return (a & b).astype(bool)


def only_held(entries: DataFrame, flt) -> DataFrame:
    """(node, nl, pos, token, sketch) of the prefix shingles that may be in the
    broadcast filter; pos is the place in the prefix."""

    def run(batches):
        for b in batches:
            lists = b.column("tokens")
            flat = lists.flatten().to_numpy()
            keep = _maybe(flt.value, flat)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            row, pos = row[keep], pos[keep]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(b.column(c).to_numpy()[row]) for c in ("node", "nl", *SKETCH)), pa.array(pos, pa.int32()), pa.array(flat[keep])],
                ["node", "nl", *SKETCH, "pos", "token"])

    return entries.mapInArrow(lean(run), f"node long, nl long, {_SKETCH_KIND}, pos int, token long")


def without_ids(documents: DataFrame, ids: DataFrame, key: Column | None = None) -> DataFrame:
    """``documents`` without the rows whose key (their doc_id, if none is given) is
    in ``ids`` (its first column); rows of a null key stay. Rows that the bit filter
    clears stay where they are; only the others are joined."""
    own, known, absent = fresh(documents, "_own", "_key", "_gone")
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias(absent)).where(F.col(absent).isNotNull()).distinct()
    shared = documents.sparkSession.sparkContext.broadcast(id_filter(gone))
    keyed = documents.withColumn(own, F.col("doc_id").cast("long") if key is None else key).withColumn(known, F.coalesce(own, F.lit(0).cast("long")))

    def mark(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(_maybe(shared.value, b.column(known).to_numpy()) == wanted))

        return keyed.mapInArrow(lean(run), keyed.schema)

    rest = mark(True).join(gone, F.col(own) == F.col(absent), "left_anti")
    return mark(False).unionByName(rest).drop(known, own)


def keep_one_of_each(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of every linked group of texts, that of the smallest doc_id. The texts
    decide, not the ids: a row whose doc_id other rows share goes or stays by its own
    text. Of several rows of that doc_id the one with the least hash of text and
    columns stays, of wholly equal rows one; a null doc_id comes last. Rows without
    words are in no group and stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c) for c, t in documents.dtypes]
    row_key = F.xxhash64(*whole)
    texts_ = documents.select(F.xxhash64(text).alias("doc_id"), F.col("text"))
    group = jaccard_components(texts_, k, percent).where("n_shingles > 0").select(F.col("doc_id").alias("h"), F.col("component_id").alias("c")).distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), row_key.alias("row"))
    rows = documents.select(rank.alias("rank"), F.lit(1).cast("long").alias("n")).groupBy("rank").agg(F.sum("n").alias("n"))
    rows = materialise(rows.select("rank", F.col("rank.h").alias("h"), F.col("rank.row").alias("row"), "n"), "copies-rows")
    first = rows.groupBy("h").agg(F.min("rank").alias("rank"), F.sum("n").alias("n")).join(group, "h")
    best = first.groupBy("c").agg(F.min("rank").alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1)
    held = materialise(first.join(best, "c").select("h", "best"), "copies-held")
    # What goes: every row of a group but its best; the best too, where it stands there
    # several times, and comes back once.
    gone = materialise(rows.join(held, "h").where((F.col("rank") != F.col("best")) | (F.col("n") > 1)).select(
        "row", (F.col("rank") == F.col("best")).alias("back")), "copies-gone")
    out = without_ids(documents, gone.select("row"), row_key)
    back = gone.where("back").select(F.col("row").alias(fresh(documents, "_row")[0])).distinct()
    if back.isEmpty():
        return out
    (mine,) = fresh(documents, "_mine")
    again = documents.withColumn(mine, row_key).join(back, F.col(mine) == F.col(back.columns[0]), "left_semi").dropDuplicates([mine]).drop(mine)
    return out.unionByName(again)


def sets_of(documents: DataFrame, wanted: DataFrame, flt, k: int) -> DataFrame:
    """(node, grams) of the wanted documents (doc_id, node), which the broadcast
    filter of doc_ids lets through; grams is the sorted set as little-endian
    64-bit integers."""
    src = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")

    def run(batches):
        hashes = WordHash()
        for b in chunks(batches, "text"):
            b = b.filter(pa.array(_maybe(flt.value, b.column("doc_id").to_numpy())))
            if b.num_rows:
                s = [shingle_set(t, k, hashes) for t in texts(b, "text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([node_of(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())],
                    ["doc_id", "node", "grams"])

    # Rows equal in id and text give their set once, before anything is shuffled.
    found = src.mapInArrow(lean(run), "doc_id long, node long, grams binary").dropDuplicates(["doc_id", "node"])
    return found.join(wanted, ["doc_id", "node"], "left_semi").select("node", "grams")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets pass the exact test."""
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb")

    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(b.column("ga"), b.column("gb"))):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return x.mapInArrow(lean(run), "a long, b long")


def shared_prefixes(entries: DataFrame, percent: int, share) -> DataFrame:
    """(token, node, n, l, cap, sketch) of the prefix shingles that several nodes hold;
    ``cap`` is the node's size without the shingles before this one that nobody
    else's prefix holds. Rows whose cap is too small for any link are left out."""
    each = entries.select("node", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    held = materialise(held.select("token"), "jaccard-held")
    rows = only_held(entries, share(id_filter(held))).join(held, "token")
    rows = rows.groupBy("node", "nl", *SKETCH).agg(F.sort_array(F.collect_set(F.struct("pos", "token"))).alias("at"))
    rows = rows.select("node", F.expr("cast(nl div 16 as int)").alias("n"), F.expr("cast(nl % 16 as int)").alias("l"), *SKETCH, F.posexplode("at").alias("before", "at"))
    rows = rows.select("at.token", "node", "n", "l", F.expr("n - at.pos + before").alias("cap"), *SKETCH).where(f"100L * cap >= {percent}L * n")
    out = materialise(rows, "jaccard-shared")
    discard(held)
    return out


def jaccard_components(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT,
                       bits: int = SKETCH_BITS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``."""
    with sharing(documents.sparkSession) as share:
        return _components(documents, k, percent, bits, star_rounds, share)


def _components(documents: DataFrame, k: int, percent: int, bits: int, star_rounds: int, share) -> DataFrame:
    rows = materialise(profile(documents, k, bits), "jaccard-rows")
    docs = rows.where("n is not null").select("doc_id", "n", "node")
    entries = materialise(prefixes(documents, share(shingle_ranks(sketch(rows, bits))), k, percent, bits), "jaccard-prefix")
    shared = shared_prefixes(entries, percent, share)
    discard(entries)
    reps = materialise(docs.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "jaccard-reps")

    size = F.expr(f"100L * least(n, pn) >= {percent}L * greatest(n, pn)")
    # Shingles after the prefix that ends first are all that a pair can share
    # besides those its prefixes share; a link needs p / (100 + p) of both sizes.
    after = lambda n, m: F.expr(f"({percent}L * {n} + 99) div 100 - {m}")
    rest = F.greatest(after("n", "l"), after("pn", "pl"))
    need = F.expr(f"({percent}L * (n + pn) + {99 + percent}) div {100 + percent}")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"p{SKETCH[0]}"))))
    able = (F.least("cap", "pcap") >= need) & (apart <= F.col("n") + F.col("pn") - 2 * need)
    partner = lambda *more: [F.col(c).alias(p) for c, p in (("node", "pivot"), ("n", "pn"), ("l", "pl"), ("cap", "pcap"), ("c", "pc"), *((c, f"p{c}") for c in SKETCH))] + list(more)
    # A round without new links changes no component, so the next one goes on with the same rows.
    component, tried, sets, have, stale = None, None, None, None, False
    cur = shared.withColumn("c", F.col("node"))
    for r in range(star_rounds + 1):
        if stale or r == star_rounds and component is None:
            discard(cur)
            cur = shared.withColumn("c", F.col("node"))
            if component is not None:
                cur = shared.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
            held = cur.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(
                F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
            cur, stale = materialise(cur.join(held, "token"), "jaccard-open"), False
        if r < star_rounds:
            # The pivot of a shingle: least of its own in the first round, by hash later.
            own = (F.col("n") - F.col("cap")) / F.col("n") if r == 0 else F.lit(0.0)
            other = cur.groupBy("token").agg(F.min(F.struct(own.alias("own"), F.xxhash64("node", F.lit(r)).alias("o"), *partner())).alias("p"))
            other = other.select("token", "p.*").drop("own", "o")
            mine, differ = cur, F.col("c") != F.col("pc")
        else:
            other = cur.select("token", *partner(F.col("main").alias("pmain")))
            mine = cur.where("c <> main")
            differ = (F.col("c") != F.col("pc")) & ((F.col("pc") == F.col("pmain")) | (F.col("c") < F.col("pc")))
        pairs = (
            mine.join(other, "token").where(differ & size & able)
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.least("l", "pl").alias("least"), rest.alias("rest"), need.alias("need"))
            .groupBy("a", "b").agg(F.count("*").alias("common"), F.max("least").alias("least"), F.max("rest").alias("rest"), F.max("need").alias("need"))
            .where("common >= least and common + rest >= need").select("a", "b")
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            continue
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if have is not None:
            nodes = nodes.join(have, "node", "left_anti")
        wanted = materialise(reps.join(nodes, "node").select("doc_id", "node"), "jaccard-wanted")
        more = materialise(sets_of(documents, wanted, share(id_filter(wanted.select("doc_id"))), k), "jaccard-sets")
        sets = more if sets is None else sets.unionByName(more)
        have = wanted.select("node") if have is None else have.union(wanted.select("node"))
        found = materialise(verified(pairs, sets, percent), "jaccard-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found.isEmpty():
            continue
        # What was linked before goes in as stars, one edge a node.
        edges = found if component is None else found.union(component.select("node", "component"))
        component, stale = materialise(connected_components(edges, "a", "b"), "jaccard-component"), True
    discard(cur)

    linked = reps.withColumn("component", F.lit(None).cast("long")) if component is None else reps.join(component, "node", "left")
    named = materialise(linked.select(
        "node", F.coalesce("component", "node").alias("c"), "doc_id"), "jaccard-named")
    small = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    each = docs.join(named.join(small, "c").select("node", "component_id"), "node", "left")
    each = each.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return _same_ids(each)


def _same_ids(each: DataFrame) -> DataFrame:
    """Merge the components of a doc_id that occurs with several texts."""
    each = materialise(each, "jaccard-each")
    many = each.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi")
    if many.isEmpty():
        return each
    cc = connected_components(each.join(many, "doc_id").select("component_id", "lo"), "component_id", "lo")
    return each.join(cc.select(F.col("node").alias("component_id"), "component"), "component_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
