"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-case words and word openings of 4 to 6 letters,
hashed. The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the
terms present: the second sum is what an additive linear model misses (an
insult together with the mention of a group).

Terms get weights and factors either for what they tell alone (likelihood ratio)
or for what they tell together. For the second, the additive part is fitted
first; the leading directions of ``X' diag(y - p) X``, the part of the labels that
it leaves over, show the terms whose pairs explain the rest (block power rounds,
the matrix is never built). The factors begin along these directions, and weights
and factors are refined together by AdaGrad.

The fit's rows are a bounded sample of labelled documents; their terms are worked
out where the rows are, one task fits the model on them, and only the model reaches
the driver.

Cases: a null text counts as empty; an empty text has no terms and gets the
bias alone; a text of any length is one set of terms; repeated rows get equal
scores; a null doc_id is never held out, and as it has no label it is not learned
from; a doc_id that is labelled twice counts with the larger label, one that
stands on several rows is learned from once, with the smallest text; extra
columns are ignored; an empty table gives an empty result; without labelled rows
every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import fitted, held_out, labelled
from .textio import chunks, fresh, lean, texts

#: At most so many labelled rows, the first in a hash order, fit the model.
FIT_ROWS = 9_000
HASH_BITS = 22
#: Terms kept for what they tell alone and for their pairs, and the labelled
#: texts that must hold one.
TERMS, LEAST = 6000, 3
PAIR_TERMS, PAIR_LEAST = 1000, 10
FACTORS = 8
THRESHOLD = 0.3
_OUTER = bytes(c for c in range(128) if not chr(c).isalnum())


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of one lower-case word, its ASCII punctuation taken off."""
    w = word.strip(_OUTER)
    if not w:
        return []
    mask = (1 << HASH_BITS) - 1
    out = [xxhash.xxh64_intdigest(w) & mask]
    s = w.decode("utf-8", "replace")
    for k in (4, 5, 6):
        if len(s) >= k:
            out.append(xxhash.xxh64_intdigest(s[:k].encode(), seed=k) & mask)
    return out


def text_terms(text: bytes, known: dict[bytes, list[int]]) -> np.ndarray:
    """Distinct terms of a text; ``known`` remembers the words' terms."""
    t: set[int] = set()
    for w in set(text.lower().split()):
        if w not in known:
            if len(known) > 300_000:
                known.clear()
            known[w] = word_terms(w)
        t.update(known[w])
    return np.sort(np.fromiter(t, np.int32, len(t)))


class Terms(dict):
    """Places of a word's terms among the kept ones, for a bounded number of words."""

    LIMIT = 300_000

    def __init__(self, kept: np.ndarray):
        super().__init__()
        self.place = {int(t): i for i, t in enumerate(kept)}

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[w] = tuple(self.place[t] for t in word_terms(w) if t in self.place)
        return v

    def of(self, text: bytes) -> list[int]:
        found: set[int] = set()
        for t in map(self.__getitem__, set(text.lower().split())):
            if t:
                found.update(t)
        return sorted(found)


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n


def _sum_rows(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(n) - n)[full], axis=0)
    return out


def raw_scores(flat: np.ndarray, n: np.ndarray, m: dict) -> np.ndarray:
    """Scores before the sigmoid; ``flat`` holds the texts' terms one after
    another, ``n`` their numbers."""
    out = np.empty(len(n), np.float32)
    for rows, part in _blocks(n):
        at, k = flat[part], n[rows]
        v = m["v"][at]
        s = _sum_rows(v, k)
        out[rows] = m["b"] + _sum_rows(m["w"][at], k) + 0.5 * ((s * s).sum(1) - _sum_rows((v * v).sum(1), k))
    return out


def _blocks(n: np.ndarray, limit: int = 1 << 17):
    """Slices of rows, and of their terms, of about ``limit`` terms."""
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        begin = int(ends[i] - n[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + limit, "right")))
        yield slice(i, j), slice(begin, int(ends[j - 1]))
        i = j


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(docs: list[bytes], terms: Terms, model: dict) -> np.ndarray:
    return _sigmoid(raw_scores(*_flat([terms.of(d) for d in docs]), model))


def fit(rows: list[np.ndarray], labels: list[int], epochs: int = 20, seed: int = 5) -> dict | None:
    """The model of texts given by their distinct terms."""
    if not rows:
        return None
    y = np.asarray(labels, np.float32)
    ones = float(y.sum())
    n = np.array([len(r) for r in rows], np.int64)
    terms, flat = np.unique(np.concatenate(rows), return_inverse=True)
    flat = flat.astype(np.int32)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    count = np.bincount(flat, minlength=len(terms))
    one = np.bincount(flat, weights=y[owner], minlength=len(terms))
    gain = np.zeros(len(terms))
    both = (count + 1) / (len(y) + 2)
    for k, m in ((one, ones), (count - one, len(y) - ones)):
        q = (k + 0.5) / (max(m, 1) + 1)
        gain += k * np.log(q / both) + (m - k) * np.log(np.clip((1 - q) / (1 - both), 1e-9, None))
    gain[count < LEAST] = 0
    best = np.argsort(-gain, kind="stable")[:TERMS]
    alone = np.zeros(len(terms), bool)
    alone[best[gain[best] > 2.0]] = True
    b = float(np.log(max(1.0, ones) / max(1.0, len(y) - ones)))
    rng = np.random.default_rng(seed)

    def model(keep: np.ndarray):
        m = {"kept": terms[keep].astype(np.int32), "w": np.zeros(int(keep.sum()), np.float32), "v": np.zeros((int(keep.sum()), FACTORS), np.float32), "b": b}
        place = (np.cumsum(keep) - 1).astype(np.int32)
        k = keep[flat]
        return m, place[flat[k]], np.bincount(owner[k], minlength=len(n))

    m, at, k = model(alone)
    _descend(m, at, k, y, rng, epochs, pairs=False)
    # Terms that tell together: those with the largest loads among the frequent.
    often = count >= PAIR_LEAST
    if often.any():
        left = y - _sigmoid(raw_scores(at, k, m))
        _, o_at, o_k = model(often)
        q, value = _pair_directions(o_at, o_k, left, int(often.sum()), rng)
        load = (q * q * np.maximum(value, 0)).sum(axis=1)
        top = np.argsort(-load, kind="stable")[:PAIR_TERMS]
        together = np.zeros(len(terms), bool)
        together[np.flatnonzero(often)[top[load[top] > 0]]] = True
        old = dict(zip(m["kept"].tolist(), m["w"].tolist()))
        bias = m["b"]
        m, at, k = model(alone | together)
        m["b"], m["w"] = bias, np.array([old.get(t, 0.0) for t in m["kept"].tolist()], np.float32)
        q, value = _pair_directions(at, k, left, len(m["kept"]), rng)
        lead = np.sqrt(np.maximum(value, 0) / max(float(np.abs(value).max()), 1e-12))
        m["v"] = (q * (0.3 / np.maximum(np.abs(q).max(axis=0), 1e-12)) * lead + rng.normal(0, 1e-3, q.shape)).astype(np.float32)
        _descend(m, at, k, y, rng, epochs, pairs=True)
    return m


def _pair_directions(flat: np.ndarray, n: np.ndarray, left: np.ndarray, terms: int, rng, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The leading directions of X' diag(left) X without its diagonal, and their
    values; ``left`` is what the additive part leaves of the labels. Columns are
    centred, so that a term in most texts does not stand for the others' own
    effects; rows weigh by their length, so that long texts do not decide alone."""
    r = (left / np.maximum(n, 1)).astype(np.float32)
    mean = np.bincount(flat, minlength=terms) / len(n)
    # Diagonal of the centred matrix: sum of left (x - mean)^2.
    own = np.bincount(flat, weights=np.repeat(r, n), minlength=terms)
    own = (own * (1 - 2 * mean) + r.sum() * mean**2).astype(np.float32)
    mean = mean.astype(np.float32)
    q = rng.normal(size=(terms, FACTORS)).astype(np.float32)
    shift = 0.0  # so that only positive directions lead: factors cannot show others
    for turned in range(rounds + 1):
        q = np.linalg.qr(q.astype(np.float64))[0].astype(np.float32)
        if q.shape[1] < FACTORS:  # fewer terms than factors
            q = np.concatenate([q, np.zeros((terms, FACTORS - q.shape[1]), np.float32)], axis=1)
        g, total, middle = np.zeros((terms, FACTORS), np.float32), np.zeros(FACTORS, np.float32), mean @ q
        for rows, part in _blocks(n):
            at, k = flat[part], n[rows]
            z = (_sum_rows(q[at], k) - middle) * r[rows, None]
            here, t = np.unique(at, return_inverse=True)
            each = np.repeat(z, k, axis=0)
            g[here] += np.stack([np.bincount(t, weights=each[:, f]) for f in range(FACTORS)], axis=1)
            total += z.sum(axis=0)
        g -= mean[:, None] * total + own[:, None] * q
        small = q.T.astype(np.float64) @ g
        value, turn = np.linalg.eigh((small + small.T) / 2)
        if turned == rounds:
            return q @ turn.astype(np.float32), value
        shift = max(shift, float(np.abs(value).max()))
        q = g + shift * q


def _descend(m: dict, flat: np.ndarray, n: np.ndarray, y: np.ndarray, rng, epochs: int, pairs: bool) -> None:
    """AdaGrad on the logistic loss in small batches; the factors only if ``pairs``."""
    gw, gv, gb = np.full(len(m["w"]), 1e-2, np.float32), np.full(m["v"].shape, 1e-2, np.float32), 1e-2
    start = np.cumsum(n) - n
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            k = n[pick]
            at = np.arange(int(k.sum())) + np.repeat(start[pick] - (np.cumsum(k) - k), k)
            here, t = np.unique(flat[at], return_inverse=True)
            w, v = m["w"][here], m["v"][here]
            vt = v[t]
            s = _sum_rows(vt, k)
            z = m["b"] + _sum_rows(w[t], k) + 0.5 * ((s * s).sum(1) - _sum_rows((vt * vt).sum(1), k))
            r = (_sigmoid(z) - y[pick]).astype(np.float32) / len(pick)
            own = np.repeat(np.arange(len(pick)), k)
            d = np.bincount(t, weights=r[own], minlength=len(here)).astype(np.float32)
            step = d + 2e-4 * w
            gw[here] += step**2
            m["w"][here] = w - 0.2 * step / np.sqrt(gw[here])
            if pairs:
                # d z / d v_i = sum of the text's factors - v_i
                dv = np.stack([np.bincount(t, weights=(r[:, None] * s)[own, f], minlength=len(here)) for f in range(v.shape[1])], axis=1)
                step = (dv - d[:, None] * v + 1e-3 * v).astype(np.float32)
                gv[here] += step**2
                m["v"][here] = v - 0.05 * step / np.sqrt(gv[here])
            g = float(r.sum())
            gb += g**2
            m["b"] -= 0.1 * g / np.sqrt(gb)


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int) -> dict | None:
    """The model, from a bounded sample of labelled rows outside the held-out part."""

    def run(batches):
        known: dict[bytes, list[int]] = {}
        for b in chunks(batches, "text", 1 << 20):
            t = [text_terms(x, known).tobytes() for x in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(t, pa.binary())], ["doc_id", "y", "terms"])

    rows = labelled(documents, labels, "toxic", ~held_out(4, 2), fit_rows)
    return fitted(rows.mapInArrow(lean(run), "doc_id long, y int, terms binary"), lambda t: fit(
        [np.frombuffer(x.as_buffer(), np.int32) for x in t.column("terms")], t.column("y").to_pylist()))


def score(documents: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """The columns of ``documents`` and the score of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop(name)

    def run(batches):
        m = shared.value
        terms = Terms(m["kept"]) if m else None
        for b in chunks(batches, "text"):
            s = scores(texts(b, "text"), terms, m) if m else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return documents.mapInArrow(lean(run), T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_civil(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier does not call toxic, columns as they are."""
    (s,) = fresh(documents, "_score")
    return score(documents, learn(documents, labels, fit_rows), s).where(F.col(s) < THRESHOLD).drop(s)


def toxicity_scores(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), learn(documents, labels, fit_rows)).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
