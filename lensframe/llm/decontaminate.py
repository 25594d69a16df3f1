"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over every passage of every document
   give TF-IDF weights; a common term weighs little, but never nothing.
2. A distributed randomised SVD of TF-IDF passages gives the latent basis: each
   task multiplies its passages with a seeded random matrix, the partial
   products are summed per block of terms on the executors, and power rounds
   sharpen the range. The basis is the index; it is fitted on all benchmark
   items and on the passages of about ``FIT_DOCUMENTS`` documents chosen by
   hash, at most ``FIT_PER_DOCUMENT`` of each (a documented bound). Every passage
   of every document is then projected.
3. Candidates are (passage, item) pairs with latent cosine at or above
   ``min_cosine``; none is capped. An item longer than a passage is searched
   for as a whole and in pieces of a passage, one for every half. An item that
   the basis does not show at all is searched for by the terms it shares with
   each passage instead.
4. A candidate is a leak if the longest common subsequence of the item with the
   passage and its surroundings covers ``min_lcs`` of the item's words, or
   ``min_lcs_answer`` of them together with the item's answer (its last
   sentence) as a whole: the paraphrase case.

The benchmark is the stated query set; it goes to the executors in blocks of
``block_items``, each block one more pass over the documents. A text is projected
in strips, so memory follows the strip and the block, not the text's length.

Cases: null or blank texts have no passages; null or blank items match nothing,
as do items without a letter or digit; a text of any length is searched whole;
repeated rows are each reported, as are repeated items under their ids; a null
doc_id is reported with a null; extra columns are ignored; empty documents or an
empty benchmark give an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.session import discard, materialise

from .jaccard import without_ids
from .textio import chunks, lean, texts

TERM_BITS = 15
#: A passage is two consecutive half-passages of so many words.
HALF = 32
RANK, EXTRA, POWER_ROUNDS = 128, 16, 1
#: Weight of a benchmark item among the sampled passages when the basis is fitted.
ITEM_WEIGHT = 6.0
#: Words projected at a time, so that their latent rows stay in the cache.
STRIP = 4096
FIT_DOCUMENTS, FIT_PER_DOCUMENT = 5_000, 8
BLOCK_ITEMS = 5_000
MIN_COSINE = 0.45
MIN_LCS, MIN_LCS_ANSWER = 0.75, 0.5
#: Added to the logarithm of a term's rarity, so that a term in every passage
#: still has a weight.
FLOOR = 0.1
#: Half-passages whose latent vectors exist at a time.
STRIP_HALVES = 2048
_OUTER = bytes(c for c in range(128) if not chr(c).isalnum())
_SENTENCE = re.compile(r"[.!?\n]+")


def bare(word: bytes) -> bytes:
    return word.strip(_OUTER)


_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 punctuation, 2 what words are made of
_KIND[list(_OUTER)] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(23).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 20


class TermIds:
    """Hashed terms of texts: a term is a lower-case word without outer punctuation,
    hashed as a polynomial of its bytes; words of punctuation alone have none. All
    words of a slice are hashed together, from running sums over its bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE + 1)
            step = np.ones((2, n), np.uint64)
            step[0, 1:], step[1, 1:] = _BASE, _INVERSE
            self.up, self.down = np.cumprod(step, axis=1)

    def _slice(self, blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a slice that begins and ends between words, and their places."""
        n = len(blob)
        self._powers(n + 1)
        kind = _KIND[blob]
        inside = np.concatenate(([False], kind > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        letter = kind == 2
        at = np.flatnonzero(letter)
        if not len(at):
            return np.zeros(0, np.int32), at
        before = np.concatenate(([0], np.cumsum(letter, dtype=np.int32)))
        first, last = before[starts], before[ends] - 1
        ok = first <= last
        s, e = at[first[ok]], at[last[ok]] + 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[blob] * self.up[:n])))
        h = (total[e] - total[s]) * self.down[s]
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TERM_BITS)).astype(np.int32), s

    def each(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the texts one after another, and how many each text has."""
        blob = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
        terms, places, lo = [], [], 0
        while lo < len(blob):
            hi = lo + SLICE
            while hi < len(blob):  # up to white space, which ends every text
                gap = np.flatnonzero(_KIND[blob[hi : hi + SLICE]] == 0)
                hi += int(gap[0]) if len(gap) else SLICE
                if len(gap):
                    break
            t, s = self._slice(blob[lo:hi])
            terms.append(t)
            places.append(s + lo)
            lo = hi
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        n = np.bincount(np.searchsorted(ends, places, "right"), minlength=len(docs)) if len(docs) else np.zeros(0, np.int64)
        return (np.concatenate(terms) if terms else np.zeros(0, np.int32)), n

    def of(self, docs: list[bytes]) -> list[np.ndarray]:
        flat, n = self.each(docs)
        return np.split(flat, np.cumsum(n)[:-1]) if len(docs) else []


def item_words(text: str | None) -> list[bytes]:
    return [x for w in (text or "").encode().lower().split() if (x := bare(w))]


def answer_words(text: str | None) -> list[bytes]:
    """Words of the last sentence that has at least two."""
    for s in reversed(_SENTENCE.split(text or "")):
        w = item_words(s)
        if len(w) >= 2:
            return w
    return []


def _halves(n: int) -> int:
    """Half-passages of n words: the rest joins the last if shorter than half of one."""
    return max(1, (n + HALF // 2) // HALF) if n else 0


def half_starts(n: int) -> np.ndarray:
    return np.arange(_halves(n)) * HALF


def pieces(n: int) -> list[tuple[int, int]]:
    """Word ranges by which an item of n words is searched for: the whole and,
    if it is longer than a passage, a passage from every half on."""
    return [(0, n)] + ([(s, min(n, s + 2 * HALF)) for s in range(0, n - HALF, HALF)] if n > 2 * HALF else [])


def reach(n: int) -> tuple[int, int]:
    """Words before and after the presumed beginning of an item of n words among
    which its LCS is taken: the item, a passage and a quarter of the item more."""
    return max(2 * HALF, n // 4), max(4 * HALF + HALF // 2, 2 * HALF + n + n // 4)


def count_terms(documents: DataFrame, seed: int = 3) -> tuple[np.ndarray, int, DataFrame]:
    """Passages holding each term and passages, over the whole table, and the
    sampled passages (terms). A task counts in one table of fixed size; the
    tables are summed by Spark."""
    rows = documents.count()
    bound = int(min(1.0, FIT_DOCUMENTS / max(1, rows)) * 2**32)

    def run(batches):
        ids, df, passages = TermIds(), np.zeros(1 << TERM_BITS, np.int64), 0
        for b in chunks(batches, "text", 1 << 20):
            each = ids.of(texts(b, "text"))
            n = np.array([len(x) for x in each])
            # Half-passages as rows of a table, the last of a document filled up with -1.
            rows = -(-n // HALF)
            table = np.full(int(rows.sum()) * HALF, -1, np.int32)
            first = (np.cumsum(rows) - rows) * HALF
            flat = np.concatenate(each)
            table[np.arange(len(flat)) + np.repeat(first - (np.cumsum(n) - n), n)] = flat
            table = np.sort(table.reshape(-1, HALF), axis=1)
            new = table >= 0
            new[:, 1:] &= table[:, 1:] != table[:, :-1]
            df += np.bincount(table[new], minlength=1 << TERM_BITS)
            passages += len(table)
            picked = []
            for i, x in zip(b.column("doc_id").to_pylist(), each):
                if len(x) and zlib.crc32(f"{seed}:{i}".encode()) < bound:
                    h = _halves(len(x))
                    at = np.argsort((np.arange(h, dtype=np.uint64) + np.uint64((i or 0) % 2**64)) * np.uint64(0x9E3779B97F4A7C15))[:FIT_PER_DOCUMENT]
                    picked += [x[k * HALF : (k + 1) * HALF if k + 1 < h else None] for k in at]
            if picked:
                yield _term_rows([None] * len(picked), [None] * len(picked), picked)
        at = np.flatnonzero(df)
        yield _term_rows([*at.tolist(), -1], [*df[at].tolist(), passages], None)

    out = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "term int, n long, terms array<int>")
    out = materialise(out, "lsi-counts")
    df, total = np.zeros(1 << TERM_BITS, np.int64), 0
    for t, n in out.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per hashed term
        if t < 0:
            total = int(n)
        else:
            df[t] = n
    return df, total, out.where("term is null").select("terms")


def _term_rows(term: list, n: list, terms: list | None) -> pa.RecordBatch:
    lists = pa.nulls(len(n), pa.list_(pa.int32())) if terms is None else pa.array(terms, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64()), lists], ["term", "n", "terms"])


def idf_weights(df: np.ndarray, total: int) -> np.ndarray:
    w = np.log((1 + total) / (1 + np.minimum(df, total))) + FLOOR
    return (w * w).astype(np.float32)  # squared: rare terms decide


def _matrix(rows: list[np.ndarray], idf: np.ndarray):
    """Terms and unit-length TF-IDF weights of passages, one after another, and
    the start of each (passages without weight are left out)."""
    terms, weights, sizes = [], [], []
    for r in rows:
        t, n = np.unique(r, return_counts=True)
        w = n * idf[t]
        norm = np.sqrt((w * w).sum())
        if norm > 0:
            terms.append(t)
            weights.append((w / norm).astype(np.float32))
            sizes.append(len(t))
    if not sizes:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64)
    return np.concatenate(terms), np.concatenate(weights), np.cumsum([0] + sizes[:-1])


def _gram_product(sample: DataFrame, q: np.ndarray, blocks: int = 64) -> np.ndarray:
    """(A^T A) q for the sampled TF-IDF rows A; q has a row per term."""
    shared = sample.sparkSession.sparkContext.broadcast(q)
    size = len(q) // blocks

    def run(batches):
        q = shared.value
        out = np.zeros_like(q)
        for b in batches:
            for t, w in zip(b.column("terms").to_pylist(), b.column("weights").to_pylist()):
                w = np.asarray(w, np.float32)
                out[t] += w[:, None] * (w @ q[t])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(blocks), pa.int32()), pa.array([out[i * size : (i + 1) * size].tobytes() for i in range(blocks)], pa.binary())],
            ["block", "part"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b.column("block").to_pylist(), b.column("part").to_pylist()):
                v = np.frombuffer(p, np.float32).astype(np.float64)
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    rows = sample.mapInArrow(lean(run), schema).repartition(4, "block").mapInArrow(lean(add), schema)
    got = rows.toArrow()  # a row per block, as large as q; one job, into however many tasks blocks are dealt
    out = np.zeros_like(q)
    for k, p in zip(got.column("block").to_pylist(), got.column("part")):
        out[k * size : (k + 1) * size] += np.frombuffer(p.as_buffer(), np.float32).reshape(size, -1)
    shared.destroy()
    return out


def orthonormal(y: np.ndarray, strip: int = 2048) -> np.ndarray:
    """Orthonormal columns that span those of ``y`` (Q of its QR). The strips' own R are
    stacked and factored again, so nothing of the size of ``y`` but the result is held."""
    at = range(0, len(y), strip)
    top = np.linalg.qr(np.concatenate([np.linalg.qr(y[i : i + strip].astype(np.float64), "r") for i in at]))[0]
    out, done = np.empty_like(y), 0
    for i in at:
        q = np.linalg.qr(y[i : i + strip].astype(np.float64))[0]
        out[i : i + strip] = q @ top[done : done + q.shape[1]]
        done += q.shape[1]
    return out


def latent_basis(picked: DataFrame, items: DataFrame, idf: np.ndarray, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms x RANK) of the TF-IDF matrix of the sampled
    passages and of all items' pieces, each divided by its singular value, so that
    the few themes that all passages share do not drown the others in the cosine."""
    shared = picked.sparkSession.sparkContext.broadcast(idf)

    def rows_of(rows: list[np.ndarray], weight: float):
        t, w, s = _matrix(rows, shared.value)
        if len(s):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.split(t, s[1:]), pa.list_(pa.int32())), pa.array(np.split(weight * w, s[1:]), pa.list_(pa.float32()))], ["terms", "weights"])

    def weigh(batches):
        for b in batches:
            yield from rows_of([np.asarray(x, np.int32) for x in b.column("terms").to_pylist()], 1.0)

    def weigh_items(batches):
        ids = TermIds()
        for b in batches:
            each = ids.of(texts(b, "text"))
            yield from rows_of([t[x:y] for t in each for x, y in pieces(len(t))], ITEM_WEIGHT)

    kind = "terms array<int>, weights array<float>"
    rows = picked.mapInArrow(lean(weigh), kind).unionByName(items.select("text").mapInArrow(lean(weigh_items), kind))
    rows = materialise(rows.repartition(4), "lsi-sample")  # few tasks, few partial products
    shared.destroy()
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(len(idf), RANK + EXTRA)).astype(np.float32)
    for _ in range(POWER_ROUNDS + 1):
        q = orthonormal(_gram_product(rows, q))
    # Rayleigh-Ritz: q^T (A^T A) q is small; its eigenvectors turn q into the basis.
    small = (q.T @ _gram_product(rows, q)).astype(np.float64)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    discard(rows)
    top = np.argsort(-value)[:RANK]
    return (q @ (vector[:, top] / np.sqrt(np.maximum(value[top], 1e-9))).astype(np.float32)).astype(np.float32)


def half_passages(flat: np.ndarray, starts: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Latent sums of the half-passages that begin at ``starts`` of ``flat``, a few
    at a time, so that their words' latent rows stay in the cache. Halves of the
    usual length add up as a table, the last ones of texts one by one."""
    out = np.empty((len(starts), weighted.shape[1]), np.float32)
    ends = np.append(starts[1:], len(flat))
    usual = np.flatnonzero(ends - starts == HALF)
    lane, some = np.arange(HALF), STRIP // HALF
    for i in range(0, len(usual), some):
        at = usual[i : i + some]
        out[at] = weighted[flat[starts[at][:, None] + lane]].sum(axis=1)
    for i in np.flatnonzero(ends - starts != HALF).tolist():
        out[i] = weighted[flat[starts[i] : ends[i]]].sum(axis=0)
    return out


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    mask: dict[bytes, int] = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def has_run(words: list[bytes], run: list[bytes]) -> bool:
    """Whether ``run`` stands in ``words`` as a whole."""
    return any(words[i : i + len(run)] == run for i, w in enumerate(words) if w == run[0]) if run else False


def leaks(documents: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, lcs, cosine, answer for every leak found: one row per
    document row and item, with the best passage's figures (no cosine where the
    item is searched for by its terms)."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null and item_id is not null")
    items = materialise(items.orderBy("item_id", "text"), "lsi-items")
    ids = TermIds()
    df, passages, picked = count_terms(documents)
    out = None
    n_items = items.count()
    if not n_items or not passages:
        return spark.createDataFrame([], RESULT)
    blocks = -(-n_items // block_items)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    idf = idf_weights(df, passages)
    basis = latent_basis(picked, items, idf)
    for k in range(blocks):
        mine = numbered.where(F.col("block") == k).toArrow()
        if not mine.num_rows:
            continue
        each = mine.column("text").to_pylist()
        terms = ids.of([t.encode() for t in each])
        parts = [(i, a, t[a:b]) for i, t in enumerate(terms) if len(t) for a, b in pieces(len(t))]
        targets = np.stack([(idf[t][:, None] * basis[t]).sum(0) for _, _, t in parts]) if parts else np.zeros((0, RANK), np.float32)
        size = np.linalg.norm(targets, axis=1)
        # Of a unit TF-IDF vector so little is left that its direction is noise.
        whole = np.array([np.linalg.norm(np.bincount(t, minlength=1) * idf[: int(t.max()) + 1]) for _, _, t in parts])
        seen = size > 1e-4 * whole
        model = {
            "idf": idf, "basis": basis, "item_id": mine.column("item_id").to_numpy(), "words": [item_words(t) for t in each], "terms": terms,
            "answer": [answer_words(t) for t in each],
            # Item of each target, and the half of the item with which the target begins.
            "item": np.array([i for i, _, _ in parts], np.int64)[seen], "half": np.array([a // HALF for _, a, _ in parts], np.int64)[seen],
            "unit": (targets[seen] / size[seen, None]).astype(np.float32),
            "blind": sorted({i for (i, _, _), ok in zip(parts, seen) if not ok}),
        }
        part = _search(documents, model, min_cosine)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item, columns as they are. The texts
    decide, by their 64-bit hash: rows without an id, and rows that share an id
    with others, stay or go by what they themselves say."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = materialise(leaks(documents.select(key.alias("doc_id"), "text"), benchmark).select("doc_id"), "leaks")
    return without_ids(documents, found, key)


RESULT = "doc_id long, item_id long, lcs double, cosine double, answer boolean"


def _hits(each: list[np.ndarray], m: dict, weighted: np.ndarray, min_cosine: float) -> dict[tuple[int, int], list[tuple[int, float]]]:
    """(text, item) -> halves of the text with which the item would begin, and cosines."""
    hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
    n = np.array([_halves(len(x)) for x in each])
    if not n.sum():
        return hits
    flat = np.concatenate(each)
    offset = np.cumsum([0] + [len(x) for x in each[:-1]])
    starts = np.concatenate([o + half_starts(len(x)) for o, x in zip(offset, each)])
    ends = np.append(starts[1:], len(flat))
    doc = np.repeat(np.arange(len(each)), n)
    first = np.cumsum(n) - n
    for lo in range(0, len(starts), STRIP_HALVES):
        hi = min(len(starts), lo + STRIP_HALVES)
        more = min(len(starts), hi + 1)  # one half further, for the last passage
        base = starts[lo]
        z = half_passages(flat[base : ends[more - 1]], starts[lo:more] - base, weighted)
        # A passage: this half and the next one of the same document.
        both = z[: hi - lo].copy()
        both[: more - lo - 1] += np.where((doc[lo + 1 : more] == doc[lo : more - 1])[:, None], z[1:], 0)
        for rows in (z[: hi - lo], both):
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            cos = rows @ m["unit"].T
            for p, t in zip(*np.nonzero(cos >= min_cosine)):
                d, i = int(doc[lo + p]), int(m["item"][t])
                hits.setdefault((d, i), []).append((int(lo + p - first[d] - m["half"][t]), float(cos[p, t])))
    for i in m["blind"]:
        mine = np.zeros(1 << TERM_BITS, bool)
        mine[m["terms"][i]] = True
        have = np.concatenate(([0], np.cumsum(mine[flat])))
        size = len(m["terms"][i])
        for p, (x, d) in enumerate(zip(starts, doc)):
            end = min(offset[d] + len(each[d]), x + max(2 * HALF, size + HALF))
            if have[end] - have[x] >= MIN_LCS_ANSWER * min(size, HALF):
                hits.setdefault((int(d), i), []).append((int(p - first[d]), float("nan")))
    return hits


def _search(documents: DataFrame, model: dict, min_cosine: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        weighted = m["basis"] * m["idf"][:, None]
        counts = [_counts(w) for w in m["words"]]
        ids, mark = TermIds(), np.zeros(1 << TERM_BITS, bool)
        for b in chunks(batches, "text", 1 << 20):
            raw = texts(b, "text")
            each = ids.of(raw)
            found = []
            words_of: dict[int, Words] = {}
            hits = _hits(each, m, weighted, min_cosine)
            for (d, i), at in _worth_it(hits, each, m["terms"], mark):
                halves = _near_enough(each[d], m["terms"][i], {h for h, _ in at}, mark)
                if not halves:
                    continue
                if d not in words_of:
                    words_of[d] = Words(raw[d], len(each[d]))
                best = _judge(words_of[d], m["words"][i], m["answer"][i], counts[i], halves)
                if best:
                    found.append((d, int(m["item_id"][i]), best[0], max(c for _, c in at), best[1]))
            if found:
                d, i, l, c, a = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(d)), pa.array(i, pa.int64()), pa.array(l),
                     pa.array([None if x != x else x for x in c], pa.float64()), pa.array(a)],
                    ["doc_id", "item_id", "lcs", "cosine", "answer"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), RESULT)


def _worth_it(hits: dict, each: list[np.ndarray], items: list[np.ndarray], mark: np.ndarray):
    """The hits whose text holds enough of the item's terms for a leak; ``mark`` is
    a table of the terms, false at the start and at the end."""
    by: dict[int, list] = {}
    for (d, i), at in hits.items():
        by.setdefault(d, []).append((i, at))
    for d, of in by.items():
        mark[each[d]] = True
        kept = [(i, at) for i, at in of if np.count_nonzero(mark[items[i]]) >= MIN_LCS_ANSWER * len(items[i])]
        mark[each[d]] = False
        for i, at in kept:
            yield (d, i), at


def _near_enough(terms: np.ndarray, item: np.ndarray, halves: set[int], mark: np.ndarray) -> list[int]:
    """The halves around which enough of the item's terms stand for a leak."""
    before, after = reach(len(item))
    out = []
    for h in sorted(halves):
        region = terms[max(0, h * HALF - before) : max(0, h * HALF + after)]
        mark[region] = True
        if np.count_nonzero(mark[item]) >= MIN_LCS_ANSWER * len(item):
            out.append(h)
        mark[region] = False
    return out


def _counts(words: list[bytes]) -> dict[bytes, int]:
    c: dict[bytes, int] = {}
    for w in words:
        c[w] = c.get(w, 0) + 1
    return c


class Words:
    """Bare words of a text, cut out and trimmed only where they are looked at."""

    def __init__(self, text: bytes, n: int):
        self.raw = text.lower().split()
        # Tokens of punctuation alone are no words.
        self.at = None if len(self.raw) == n else [i for i, w in enumerate(self.raw) if bare(w)]

    def between(self, lo: int, hi: int) -> list[bytes]:
        part = self.raw[lo:hi] if self.at is None else [self.raw[i] for i in self.at[lo:hi]]
        return [w.strip(_OUTER) for w in part]


def _judge(words: Words, item: list[bytes], answer: list[bytes], counts: dict[bytes, int], halves: list[int]):
    """Best (share of the item in the LCS, answer found) where the item would
    begin with one of ``halves``, or None. The words in common bound the LCS from above."""
    best = None
    before, after = reach(len(item))
    for h in halves:
        lo, hi = max(0, h * HALF - before), max(0, h * HALF + after)
        region = words.between(lo, hi)
        have = _counts([w for w in region if w in counts])
        upper = sum(min(c, counts[w]) for w, c in have.items())
        if upper < MIN_LCS_ANSWER * len(item):
            continue
        share = lcs_length(item, region) / len(item)
        # A run of the right length, not words strewn over the whole region.
        answered = has_run(region, answer)
        if share >= MIN_LCS or share >= MIN_LCS_ANSWER and answered:
            best = max(best or (0.0, False), (share, answered))
    return best
