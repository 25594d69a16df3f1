"""Cases that the operators once left out."""

import numpy as np

from lensframe.llm.textio import table

SF, ITEMS = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_leaks_find_every_paraphrase(spark):
    """About a third of the words kept, the answer whole: every pair that the rule names."""
    from lensframe.llm.decontaminate import answer_words, has_run, item_words, lcs_length, leaks

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in table(spark, ITEMS, "benchmark").orderBy("item_id").collect()]
    hosts = [t.split() for _, t in docs if len(t.split()) > 150]
    rng, want = np.random.default_rng(5), set()
    for n, (i, text) in enumerate(items):
        words, host = text.split(), list(hosts[n % len(hosts)])
        at, body = int(rng.integers(40, 80)), max(0, len(words) - len(answer_words(text)))
        host[at:at] = [w if k >= body or rng.random() < 0.35 else host[int(rng.integers(len(host)))] for k, w in enumerate(words)]
        docs.append((100_000 + n, " ".join(host)))
        item, region = item_words(text), item_words(" ".join(host))[max(0, at - 64) : at + 140]
        share = lcs_length(item, region) / len(item)
        if share >= 0.75 or share >= 0.5 and has_run(region, answer_words(text)):
            want.add((100_000 + n, i))
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 100 and want - got == set()


def test_leaks_of_long_items(spark):
    from lensframe.llm.decontaminate import leaks

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    words = " ".join(r.text for r in table(spark, ITEMS, "benchmark").orderBy("item_id").collect()).split()
    hosts = [t.split() for _, t in docs if len(t.split()) > 250]
    rng, items, at = np.random.default_rng(7), [], 0
    for n in (70, 100, 150, 300, 450, 1000):
        item, host = words[at : at + n], hosts[n % len(hosts)]
        at += n
        items.append((100_000 + n, " ".join(item)))
        docs.append((100_000 + n, " ".join(host[:77] + item + host[77:])))
        docs.append((100_001 + n, " ".join(w if rng.random() < 0.85 else host[k % len(host)] for k, w in enumerate(item))))  # one word in seven replaced
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(n + k, n) for n, _ in items for k in (0, 1)} - got == set()


def test_near_copies_stage_at_082(spark):
    """100 shingles of five words, and the same text with 22 more: 100 of 122."""
    import corpus_pipeline

    text = [f"w{i}" for i in range(126)]
    docs = spark.createDataFrame([(1, " ".join(text[:104])), (2, " ".join(text))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()] == [1]


def test_leaks_where_the_index_is_fitted_on_a_small_part(spark, monkeypatch):
    """The basis comes from 2 % of the documents, yet every document is searched: brute force finds hardly more."""
    from lensframe.llm import decontaminate
    from tests.llm.test_operators import brute_leaks

    monkeypatch.setattr(decontaminate, "FIT_DOCUMENTS", 20)
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text")
    _, passages, picked = decontaminate.count_terms(docs)
    assert 0 < picked.count() < passages / 20
    rng, bench = np.random.default_rng(6), [tuple(r) for r in items.collect()]
    rows = [tuple(r) for r in docs.collect()]
    for n, (_, text) in enumerate(rows[:200]):  # and paraphrases of items
        body = [f"other{rng.integers(0, 9**6)}" if rng.random() < 0.2 else w for w in bench[n % len(bench)][1].split()]
        rows.append((10**6 + n, " ".join([*text.split()[:50], *body, *text.split()[50:]])))
    want = brute_leaks(rows, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)
