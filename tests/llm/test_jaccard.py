import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm.components import connected_components
from weftgraph.llm.jaccard import fold, jaccard_classes, signature, signature_bits

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in sets}


def family(r, size, n_words, rate, vocab):
    base = [r.choice(vocab) for _ in range(n_words)]
    return [" ".join(r.choice(vocab) if r.random() < rate else w for w in base) for _ in range(size)]


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for rate in (0.0, 0.005, 0.02, 0.04, 0.06):
        texts += family(r, 12, r.randint(30, 200), rate, vocab)
    texts += [passage + " " + " ".join(r.choice(vocab) for _ in range(k)) for k in (0, 2, 5, 8, 12, 40, 41, 42, 80, 300)]
    texts += [texts[0].upper(), texts[1].replace(" ", "\n\t"), "one", "ONE", "one two", "one two three", None, "", " \n", None]
    texts += [" ".join(texts[3].split()[: -k or None]) for k in range(12)]
    return list(enumerate(texts, 10))


def test_against_brute_force(docs_of):
    for seed, (n, num, den) in ((1, (4, 85, 100)), (2, (5, 80, 100)), (3, (2, 60, 100))):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs_of(rows), n=n, num=num, den=den).collect()}
        want = brute(rows, n, num, den)
        assert got == {i: (len(shingles(t, n)), want[i]) for i, t in rows}


def test_dealt_tiles(docs_of, monkeypatch):
    """With small limits, frequent entries are told apart and dealt to several tiles."""
    from weftgraph.llm import jaccard

    rows = corpus(4)
    want = brute(rows, 4, 85, 100)
    for limits in ({"LEAST_FREQUENT": 4, "LOCAL": 2, "TILE": 3}, {"BLOCK": 4, "PARTNERS": 2}):
        for name, value in limits.items():
            monkeypatch.setattr(jaccard, name, value)
        assert {r.doc_id: r.component_id for r in jaccard_classes(docs_of(rows)).collect()} == want


def test_blocks_cover_all_pairs():
    from weftgraph.llm import jaccard

    sizes = np.sort(np.random.default_rng(2).integers(80, 120, 1500))
    for sides in (np.zeros(1500, dtype=np.int32), np.random.default_rng(3).integers(0, 2, 1500).astype(np.int32)):
        seen = np.zeros((1500, 1500), dtype=int)
        for places, own, _ in jaccard._blocks(0, 1500, sizes, sides, 85, 100):
            assert len(places) <= jaccard.BLOCK and (np.diff(places) > 0).all()
            cross = np.ones((len(places),) * 2, dtype=bool) if (own == own[0]).all() else own[:, None] != own[None]
            seen[np.ix_(places, places)] += cross
        close = 100 * sizes[:, None] >= 85 * sizes[None]
        need = np.triu(close & close.T & ((sides[:, None] != sides[None]) if sides.any() else True), 1)
        assert (seen[need] >= 1).all()


def test_odd_rows(docs_of):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (7, "z"), (8, None)]
    got = jaccard_classes(docs_of(rows).withColumn("n", F.lit("clash")).withColumn("bits", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 3, 0), (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 1, 7), (8, 0, 8)]
    assert jaccard_classes(docs_of(rows).where("false")).count() == 0


def test_versions_of_one_id(docs_of):
    """Texts of equally many shingles under one id keep the links of each, and link what is equal to them."""
    r = random.Random(8)
    x, y, z = ([f"{c}{i}" for i in r.sample(range(900), 60)] for c in "xyz")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(10, " ".join(x)), (10, " ".join(y)), (20, near(x)), (21, near(y)), (5, " ".join(z)), (30, " ".join(z)), (30, " ".join(x[::-1])), (31, near(x[::-1]))]
    for order in (rows, rows[::-1]):
        got = {(i.doc_id, i.component_id) for i in jaccard_classes(docs_of(order)).collect()}
        assert got == set(brute(rows, 4, 85, 100).items()) == {(10, 10), (20, 10), (21, 10), (5, 5), (30, 5), (31, 5)}


def test_signatures_bound_the_difference():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, 9).astype(np.uint64)]))
        x, y = signature(a, signature_bits(len(a))), signature(b, signature_bits(len(b)))
        w = min(len(x), len(y))
        assert np.bitwise_count(fold(x, w) ^ fold(y, w)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(200, 200), (None, 3)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {x.node: x.component for x in connected_components(df).collect()} == {x: find(x) for x in root}
    assert connected_components(df.where("false")).count() == 0


def test_hot_entry_spread_thin(spark, docs_of, monkeypatch):
    """An entry of more classes than a task gathers is dealt, though no task has seen it often."""
    from weftgraph.llm import jaccard
    from weftgraph.llm.cluster import Scratch

    monkeypatch.setattr(jaccard, "TILE", 8)
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    # Each text has the same four words somewhere, three texts to a partition; few are near copies.
    texts = [r.sample(vocab, 12) for _ in range(45)]
    texts = [[*t[:5], "all", "rights", "are", "reserved", *t[5:]] for t in texts] + [[*t[:5], "all", "rights", "are", "reserved", *t[5:], "x"] for t in texts[:15]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = docs_of(rows, parts=20)
    src = df.select(F.col("doc_id").alias("id"), "text")
    known = jaccard.features(src, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 4, 20, 100)
    entries = jaccard.dealt_entries(known, Scratch(spark))
    most = entries.groupBy("g", "i", "j").count().agg(F.max("count")).first()[0]
    assert known.select(F.explode("prefix").alias("g")).groupBy("g").count().agg(F.max("count")).first()[0] >= 45 and most <= 4 * 8
    for num in (20, 70):
        got = {x.doc_id: x.component_id for x in jaccard_classes(df, num=num).collect()}
        assert got == brute(rows, 4, num, 100)


def test_runs_over_several_batches():
    import pyarrow as pa

    from weftgraph.llm.jaccard import _groups

    keys = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    for size in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size], "v": list(range(i, min(i + size, len(keys))))}) for i in range(0, len(keys), size)]
        runs = []
        for table, starts in _groups([batches[0].slice(0, 0), *batches], ["k"]):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                runs.append((set(table.column("k")[a:b].to_pylist()), table.column("v")[a:b].to_pylist()))
        assert [k for k, _ in runs] == [{1}, {2}, {3}, {4}, {5}] and [x for _, v in runs for x in v] == list(range(len(keys)))


def test_very_long_texts(docs_of):
    r = random.Random(13)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-900], "end"])), (3, " ".join(words[:45_000])), (4, "short text")]
    got = {x.doc_id: x.component_id for x in jaccard_classes(docs_of(rows)).collect()}
    assert got == brute(rows, 4, 85, 100) and got[2] == 1 and got[3] == 3
