import random

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm.toxicity import Chain, best_cut, fit_chain, score_toxicity


def corpus(n=600, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words, toxic, poor = [word() for _ in range(30)], i % 5 == 0, i % 3 == 0
        if toxic:
            words[7] = r.choice(["grumb", "Zokka" + word(), "vilefex"])
            words[9] = r.choice(["grumb", "zokka" + word()])
        if poor:
            words[3:6] = ["clickbuy"] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_held_out(spark, docs_of):
    docs, labels = corpus()
    table = spark.createDataFrame(labels[:450] + [(9999, 1, 1), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs_of(docs[:450]), table)
    got = {r.doc_id: r for r in score_toxicity(docs_of([*docs[450:], (-1, None), (-2, "")]).withColumn("_p_toxic", F.lit("x")), chain).collect()}
    right = sum(got[i]._is_toxic == bool(t) for i, _, t in labels[450:])
    assert right >= 148
    assert sum(got[i]._is_low_quality == (not q) for i, q, _ in labels[450:]) >= 148
    assert not got[-1]._is_toxic and got[-1]._p_toxic == got[-2]._p_toxic
    assert all(0 <= r._p_toxic <= 1 for r in got.values())


def test_chain_uses_earlier_categories():
    # The second category is the first one's, and no feature tells it but those of the first.
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 400)
    # A feature of its own makes each text another one, as copies are in one fold.
    text = np.repeat(np.arange(400), 2)
    feature = np.column_stack([np.where(y == 1, 7, 8), 100 + np.arange(400)]).ravel().astype(np.uint32)
    chain = Chain.fit(["a", "b"], text, feature, np.column_stack([y, y]), most=1)
    assert chain.links[1].before[0] > 0


def test_degenerate(spark, docs_of):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for labels in (none, one_class):
        rows = score_toxicity(docs_of(docs), fit_chain(docs_of(docs), labels)).collect()
        assert len(rows) == 20 and not any(r._is_toxic for r in rows)
    assert score_toxicity(docs_of(docs).where("false"), fit_chain(docs_of(docs), one_class)).count() == 0
    assert best_cut(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0])) == 0.5


M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def word_hash(word):
    """Hash of a word's bytes, one byte after the other."""
    total, power = 0, 1
    for b in word.lower():
        total = (total + mixed((b * 0xC2B2AE3D27D4EB4F + 1) & M) * power) & M
        power = power * 0x9E3779B97F4A7C15 & M
    return mixed((total + len(word)) & M)


def brute_scores(chain, text):
    """The chain's probabilities, word by word."""
    import math
    import re

    found = set()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        found.add(mixed(word_hash(w)) >> 32)
        found |= {mixed((word_hash(w[:n]) + n) & M) >> 32 for n in (4, 5) if len(w) > n}
    out = []
    for link in chain.links:
        weights = dict(zip(link.keys.tolist(), link.weights.tolist(), strict=True))
        z = link.bias + sum(weights.get(f, 0.0) for f in found) + sum(b * p for b, p in zip(link.before.tolist(), out, strict=True))
        out.append(1 / (1 + math.exp(-z)))
    return out


def test_scores_against_brute_force(spark, docs_of):
    docs, labels = corpus(200)
    docs += [(900, None), (901, ""), (902, "ÜBEL grumb, Zokkaé!"), (903, "grumb " * 60_000 + "zokkatail"), (904, "12 .,")]
    chain = fit_chain(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sum(len(x.keys) for x in chain.links) > 4
    texts = dict(docs)
    for r in score_toxicity(docs_of([*docs, docs[0]]), chain).collect():
        low, toxic = brute_scores(chain, texts[r.doc_id])
        assert abs(r._p_low_quality - low) < 1e-9 and abs(r._p_toxic - toxic) < 1e-9
        assert r._is_toxic == (r._p_toxic > chain.cuts[1])


def test_copies_are_in_one_fold():
    """A word that only the copies of one text have says nothing about them out of fold."""
    text = np.repeat(np.arange(60), 2)
    feature = np.array([x for i in range(60) for x in ((1, 2) if i < 30 else (100 + i, 3))], dtype=np.uint32)
    y = (np.arange(60) < 30).astype(int)
    seen = []
    import weftgraph.llm.toxicity as module

    real = module.best_cut
    module.best_cut = lambda p, y: seen.append(p) or real(p, y)
    try:
        Chain.fit(["a"], text, feature, y[:, None])
    finally:
        module.best_cut = real
    assert np.ptp(seen[0][:30]) == 0


def test_repeated_and_contradicting_ids(spark, docs_of):
    """An id on many rows is learned from once, and the larger of its labels counts."""
    from weftgraph.llm.toxicity import training_rows

    docs = docs_of([(1, f"text {i}") for i in range(50)] + [(2, "b"), (2, None), (None, "c"), (3, "tie")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, {"low": "1 - quality", "toxic": "toxic"}, "doc_id", "text", 100).collect()
    assert sorted(r.y for r in rows) == [[0, 1], [1, 0]]


def test_recall_on_held_out_labels():
    """Fitted on two thirds of the real labels and scored on the rest, for each third."""
    import os
    import zlib

    import duckdb
    import pyarrow as pa
    import pytest

    from weftgraph.llm.toxicity import text_features

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = duckdb.connect().execute(f"select doc_id, text, quality, toxic from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    third = np.array([zlib.crc32(str(r[0]).encode()) % 3 for r in rows])
    toxic = np.array([r[3] for r in rows])
    found = lost = 0
    for k in range(3):
        own, rest = [r for r, t in zip(rows, third, strict=True) if t != k], [r for r, t in zip(rows, third, strict=True) if t == k]
        texts, features = [], []
        for i, blocks, owner, _ in text_features(pa.array([r[1] for r in own])):
            both = np.unique(np.concatenate([(owner.astype(np.uint64) << np.uint64(32)) | f for f in blocks]))
            texts.append((both >> np.uint64(32)).astype(np.int64) + i)
            features.append((both & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        chain = Chain.fit(["low", "toxic"], np.concatenate(texts), np.concatenate(features), np.array([[1 - r[2], r[3]] for r in own]))
        called = chain.predict(pa.array([r[1] for r in rest]))[:, 1] > chain.cuts[1]
        found += int((called & (toxic[third == k] == 1)).sum())
        lost += int((called & (toxic[third == k] == 0)).sum())
    print(f"toxic found {found} of {toxic.sum()}, clean lost {lost} of {(toxic == 0).sum()}")
    assert found >= 0.9 * toxic.sum() and lost <= 0.006 * (toxic == 0).sum()
