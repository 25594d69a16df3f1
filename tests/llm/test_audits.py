"""Divergence audit, personal data and hard negatives: brute force and edge cases."""

import hashlib
import re

import numpy as np
import pytest

from lensframe.llm import registry
from lensframe.llm.divergence import StripeTable, divergences, shares, terms_of
from lensframe.llm.negatives import hard_negatives, labelled_vectors, primes_for, product, residues
from lensframe.llm.pii import KINDS, pii_digest
from tests.compare import connection, same

SF = "/root/testdata/sf0.001"
SPECIAL = "doc_id long, text string, lang string, source string, part string, n long, e string"


@pytest.mark.parametrize("name", ["op11_divergence", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], connection())


# -- op11 ---------------------------------------------------------------------
def brute_divergences(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        mine = [(s, t) for x, s, t in docs if x == lang]
        df = {}
        for _, t in mine:
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        kept = sorted(w for w in df if df[w] >= least)
        count = {}
        for s, t in mine:
            c = count.setdefault(s, {})
            for w in t:
                if w in df and df[w] >= least:
                    c[w] = c.get(w, 0) + 1
        whole = {w: sum(c.get(w, 0) for c in count.values()) for w in kept}
        p = lambda c: {w: 1 + 10**9 * (c.get(w, 0) + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        q, ps = p(whole), {s: p(c) for s, c in count.items()}
        for s in ps:
            pair = [(sum(abs(ps[s][w] - ps[o][w]) for w in kept), o) for o in ps if o != s]
            term = [(ps[s][w] - q[w], w) for w in kept if count[s].get(w) and ps[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def odd_documents():
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "ünï", "Ünï", "日本", "x1y", "don't", "a_b"]
    rows = [(" ".join(words[i] for i in rng.integers(len(words), size=rng.integers(0, 12))), ["en", "de", None, ""][k % 4], ["a", "b", None, "", "çé"][k % 5]) for k in range(200)]
    return rows + [(None, "en", "empty"), ("", "xx", "only"), ("12 34", "xx", "other"), ("q" * 5000 + " alpha", "en", "a"), ("alpha " * 300_000, "en", "a")] + [rows[0]] * 5


@pytest.mark.parametrize(("limit", "slab"), [(300_000, 1024), (3, 2)])
def test_divergences_equal_brute_force(spark, limit, slab):
    """A table that spills at once and slabs of two groups give the same rows."""
    rows = odd_documents()
    docs = spark.createDataFrame([(k, *r, "x", 1, "y") for k, r in enumerate(rows)], SPECIAL).repartition(3)
    got = divergences(docs, least=5, top=4, limit=limit, slab=slab).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got) == brute_divergences(rows, 5, 4)


def test_divergence_parts(spark):
    assert divergences(spark.createDataFrame([], SPECIAL)).count() == 0
    assert [w for p in terms_of(b"ab " * 10, piece=4) for w in p] == [b"ab"] * 10
    big = np.array([10**13, 0], np.int64)
    total = np.array([3 * 10**13, 3 * 10**13], np.int64)
    assert shares(big, total).tolist() == [1 + 10**9 * (c + 5) // (3 * 10**13) for c in (10**13, 0)]
    t = StripeTable(limit=1000)
    assert t.add(b"z" * 100_000, "en", "a")  # one huge term fills the table


# -- op12 ---------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (name, rule) in enumerate(PLAIN.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (name == "email" or name == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or name == "card" and 14 <= len(d) <= 19 and luhn(d) or name == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_rows():
    rows = [
        "mail a@b.co, c_d@e.fg.h-i@j.kl x@y 1.2.3.4.5.6.7.8 300.1.1.1 00255.1.2.3 😀 4111 1111 1111 1111 +1 (555) 010-2030. ü+44-20 7946 0958",
        None, "", "1" * 20_000, "a" * 100_000 + "@b.c", "a@b.c " * 3000, "+1" + " " * 10_000, "1.1.1.1 a@b.c_d@e.fg", "1.1.1.1", "1.1.1.1",
        "4111-1111-1111-1111 4111111111111112 +123 1.2.3", "x +1 555 010 2030 4 4111 1111 1111 1111 1.2.3.4"]
    rng = np.random.default_rng(1)
    letters = list("a@b. -+().0123456789\n")
    return rows + ["".join(letters[i] for i in rng.integers(len(letters), size=300)) for _ in range(60)]


def test_base_spans_equal_brute_force(spark):
    texts = personal_rows()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, base string")
    got = pii_digest(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute_spans(texts[r.doc_id or 0])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert set(filter(None, written(want).split(","))) <= set(r.spans.split(","))
    assert pii_digest(docs.limit(0)).count() == 0
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.op12_pii(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(written(brute_spans(whole[r.doc_id])).encode()).hexdigest()


def test_patterns_discover_unseen_identifiers(spark):
    """Numbers without a plus after words that introduce phone numbers, addresses with a
    bracketed "at", IPv6; the same after plain words is left alone; what an accepted
    instance says elsewhere counts too."""
    texts = [f"word {i} then\nreach phone: +1 (555) 010-20{i:02d} today, mailto: u{i}@host{i}.org and host= 10.0.{i}.1" for i in range(20)]
    texts += ["my phone: (020) 7946-0958 please", "phone: 5550001234 number 5550001234 of phone: 5550001234", "mailto: joe [at] mail.com", "host= 2001:db8::ff00:42:8329",
              "only 7946095800 here", "joe [at] mailbox.com", "order 123456789 of 20240101", "phone: none, 555 0100 99"]
    rows = {r.doc_id: r for r in pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {k: rows[k].spans for k in range(20, 28)}
    place = lambda k, v: (texts[k].index(v), texts[k].index(v) + len(v))
    assert found[20] == "phone:{}:{}".format(*place(20, "(020) 7946-0958"))
    assert found[21] == written([(m.start(), 3, m.end()) for m in re.finditer("5550001234", texts[21])])
    assert found[22] == "email:{}:{}".format(*place(22, "joe [at] mail.com"))
    assert found[23] == "ip:{}:{}".format(*place(23, "2001:db8::ff00:42:8329"))
    assert [found[k] for k in (24, 25, 26, 27)] == [""] * 4
    assert all(rows[k].n_found == 0 for k in range(20))


# -- op13 ---------------------------------------------------------------------
def test_residue_product_is_exact():
    rng = np.random.default_rng(2)
    for top, dim in ((200, 64), (10**6, 3000), (2 * 10**7, 70)):
        a, b = (rng.integers(-top, top + 1, (5, dim)) for _ in "ab")
        primes = primes_for(int(top) ** 2 * dim)
        assert (product(residues(a, primes), residues(b, primes), primes) == a @ b.T).all()
    with pytest.raises(ValueError):
        primes_for(1 << 60)


def brute_negatives(rows):
    x = []
    for i, (ident, v, label) in enumerate(rows):
        if ident is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x.append((i, ident, (label + 1) % 10 if ident % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = []
    for i, ident, label, v in x:
        if ident % 100:
            continue
        s = sorted((-int(np.dot(v, w)), j, lab) for k, j, lab, w in x if k != i and len(w) == len(v))
        for p in [r for r in s if r[2] == label][:5]:
            n = [r for r in s if r[2] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:10]
            out += [(ident, p[1], k, r[1], -p[0], -r[0]) for k, r in enumerate(n, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    """Ties, equal rows, repeated ids, other lengths, nulls; small blocks."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in rng.integers(-3, 6, 4) / 8], int(rng.integers(3))) for k in range(400)]
    rows += [(k, [0.5, 0.25, 0.0, 0.5], 1) for k in range(400, 500)] + [rows[0], rows[100], rows[100], (100, [0.5, 0.5, 0.5, 0.5], 2)]
    rows += [(600, [1.0, 1.0], 1), (601, [1.0, 0.5], 1), (602, [0.5, 0.25], 2), (None, [1.0] * 4, 1), (700, None, 1), (700, [1.0, None, 1.0, 1.0], 1),
             (700, [float("nan")] * 4, 1), (700, [1.0] * 4, None), (800, [], 1), (900, [0.0] * 4, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, x string, rid long").repartition(3)
    got = hard_negatives(labelled_vectors(df), "vec_id % 100 = 0", anchor_block=3).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == brute_negatives(rows)
    assert hard_negatives(labelled_vectors(df.limit(0)), "true").count() == 0
    with pytest.raises(ValueError):
        hard_negatives(labelled_vectors(spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")), "true")
