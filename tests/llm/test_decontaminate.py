import random
import re

from pyspark.sql import functions as F

from weftgraph.llm.decontaminate import decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=13):
    out = {}
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for k in range(len(v) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data(seed):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "été", "x1", "9", "ÜBER", "g", "Z_z"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 5, 13, 14, 20]))) for i in range(8)] + [(90, None), (91, "..."), (92, "")]
    docs = []
    for i in range(30):
        parts = [text(r.randint(0, 60))] + [r.choice(items)[1] or "" for _ in range(r.randint(0, 2))] + [text(r.randint(0, 300))]
        docs.append((i, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "--")], items


def test_against_brute_force(spark, docs_of):
    for seed in (1, 2):
        docs, items = data(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for limit in (10**6, 60):
            got = {r.doc_id: (r._n_words, r._n_hit, list(r._items), r._contaminated) for r in find_contamination(docs_of(docs), bench, block_chars=limit).collect()}
            assert got == brute(docs, items), (seed, limit)


def test_removal(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(15))
    docs = [(1, f"before {item} after"), (2, "clean text"), (3, item + " tail" * 400), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = docs_of(docs).withColumn("_hits", F.lit("clash"))
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate(df, bench, remove="spans").collect()}
    assert cut == {1: "before  after", 2: "clean text", 3: " tail" * 400, 4: None}
    assert decontaminate(df, bench).columns == df.columns


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r._n_hit for r in find_contamination(docs_of([(1, "a")]), none).collect()] == [0]
    assert find_contamination(docs_of([(1, "a")]).where("false"), none).count() == 0


def test_long_items_in_pieces_and_five_blocks(spark, docs_of, monkeypatch):
    """Items that are split lose no window, and hits from several blocks are put together."""
    from weftgraph.llm import decontaminate as module

    monkeypatch.setattr(module, "PIECE_WORDS", 15)
    r = random.Random(4)
    words_ = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words_)), (1, " ".join(words_)), (2, " ".join(words_[100:140])), (3, "w7 w8"), (4, "w399")]
    docs = [(i, " ".join(["x"] * r.randint(0, 9) + words_[a : a + n] + ["y"] * r.randint(0, 9))) for i, (a, n) in enumerate((r.randint(0, 380), r.randint(5, 60)) for _ in range(25))]
    docs += [(50, " ".join(words_)), (52, None), (53, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    pieces = module.item_pieces(bench, "item_id", "text", 13)
    total = sum(len(x.t) for x in pieces.collect())
    assert len(module._blocks(pieces, total // 4)) >= 5
    want[51] = (200_400, 400, ["1", "2", "3", "4"], False)
    rows = [*docs, docs[0], docs[0], (51, " ".join(words_) + " z" * 200_000)]
    for limit in (10**6, total // 4):
        found = find_contamination(docs_of(rows), bench, block_chars=limit).collect()
        assert len(found) == len(rows)
        got = {x.doc_id: (x._n_words, x._n_hit, list(x._items), x._contaminated) for x in found}
        assert got == want, limit


def test_index_of_equal_hashes(monkeypatch):
    """Windows whose hashes collide are told apart by their words."""
    import numpy as np
    import pyarrow as pa

    from weftgraph.llm import decontaminate as module

    monkeypatch.setattr(module, "run_hashes", lambda words, n: np.full(max(0, len(words) - n + 1), 7, dtype=np.uint64))
    index = module.WindowIndex([("a", "one two three"), ("b", "two three"), ("c", "four"), ("d", "one two three")], 2)
    assert index.scan(pa.array(["One two", "two-three", "three four", "five", None]))[:2] == ([2, 2, 2, 1, 0], [["a", "d"], ["a", "b", "d"], ["c"], [], []])


def test_own_columns_survive(spark, docs_of):
    clashing = ["_items0", "_hits0", "_items", "_hits", "_n_words", "_n_hit", "_contaminated", "_cut", "items", "runs", "h1", "probable", "_slot", "_word", "_bits", "c0"]
    item = " ".join(f"w{i}" for i in range(30))
    df = docs_of([(1, f"before {item} after"), (2, "clean text")])
    for k, name in enumerate(clashing):
        df = df.withColumn(name, F.concat(F.lit(f"own {k} "), "doc_id"))
    bench = spark.createDataFrame([(1, item), (2, "other words"), (3, "still more of them")], "item_id long, text string")
    for limit in (10**6, 20):
        for remove, ids in (("documents", [2]), ("spans", [1, 2])):
            got = decontaminate(df, bench, remove=remove, block_chars=limit)
            assert got.columns == df.columns
            rows = sorted(got.collect(), key=lambda r: r.doc_id)
            assert [r.doc_id for r in rows] == ids and all(r[n] == f"own {k} {r.doc_id}" for r in rows for k, n in enumerate(clashing))
    found = find_contamination(df, bench, block_chars=20).collect()
    assert all(r._items0 == f"own 0 {r.doc_id}" and r.probable.startswith("own") for r in found) and sorted(r._n_hit for r in found) == [0, 30]
