from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, docs_of, tmp_path):
    """Each stage does its part on planted documents, and leaves clean ones as they were."""
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    para = lambda n: " ".join(word() for _ in range(n))
    passage = para(40)
    docs, labels = [], []
    for i in range(300):
        text = para(80) + "\n" + para(40)
        if i < 80:
            text += " grumbtox " + para(5) + " grumbtox"
        docs.append((i, text, "s"))
        labels.append((i, 1, int(i < 80)))
    docs += [(1000, para(60) + " grumbtox " + para(10) + " grumbtox grumbtox", "s")]
    docs += [(2000 + i, f"{para(50)}\nall rights of this site are kept", "site") for i in range(30)]
    base = para(200)
    docs += [(3000, base, "s"), (3001, base, "s"), (3002, base.replace(base.split()[50], "other", 1), "s")]
    docs += [(4000, para(50) + " " + passage, "s"), (4001, None, "s"), (4002, "", "s")]
    df = docs_of(docs)
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    seen = {}
    docs_now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_now, folder)
        assert out.columns == df.columns
        out.write.parquet(f"{folder}/{name}")
        docs_now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {x.doc_id: x.text for x in docs_now.collect()}
    every = dict((d[0], d[1]) for d in docs)
    assert not set(range(80)) & set(seen["toxicity"]) and 1000 not in seen["toxicity"]
    assert set(range(80, 300)) <= set(seen["toxicity"]) and 4001 in seen["toxicity"]
    assert not any("rights" in (t or "") for t in seen["line_dedup"].values()) and len(seen["line_dedup"]) == len(seen["toxicity"])
    assert set(seen["line_dedup"]) - set(seen["ngram_jaccard"]) == {3001, 3002}
    assert set(seen["ngram_jaccard"]) - set(seen["decontaminate"]) == {4000}
    clean = [i for i in range(80, 300)] + [3000, 4001, 4002]
    assert all(seen["decontaminate"][i] == every[i] for i in clean)
    packed = corpus_pipeline.run(spark, folder)
    assert {x.doc_id for x in packed.select("doc_id").collect()} == set(seen["decontaminate"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_against_brute_force(spark, con):
    """On the smallest test tables each stage's rows are those of a plain version of it."""
    import numpy as np
    import pyarrow as pa

    from tests.llm import test_decontaminate, test_jaccard, test_line_dedup
    from weftgraph.llm.line_dedup import MIN_PAGES, RATIO
    from weftgraph.llm.toxicity import fit_chain

    folder = con[1]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(x) for x in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((x.doc_id, x.text, x.source) for x in df.collect())

    now = rows(docs)
    chain = fit_chain(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    p = chain.predict(pa.array([t for _, t, _ in now]))
    want = [r for r, toxic in zip(now, p[:, 1] > chain.cuts[1], strict=True) if not toxic]
    assert np.ptp(p[:, 1]) > 0.1
    got = stages["toxicity"](spark, docs, folder)
    assert rows(got) == want

    text = dict(test_line_dedup.brute(want, RATIO, MIN_PAGES))
    want = [(i, text[i], s) for i, _, s in want]
    got = stages["line_dedup"](spark, got, folder)
    assert rows(got) == want

    root = test_jaccard.brute([(i, t) for i, t, _ in want], 5, 80, 100)
    want = [r for r in want if root[r[0]] == r[0]]
    got = stages["ngram_jaccard"](spark, got, folder)
    assert rows(got) == want

    found = test_decontaminate.brute([(i, t) for i, t, _ in want], items)
    want = [r for r in want if not found[r[0]][3]]
    assert rows(stages["decontaminate"](spark, got, folder)) == want


def test_odd_tables(spark, docs_of, tmp_path):
    """Empty tables, repeated rows, nulls in every column and columns with the operators' names."""
    folder = str(tmp_path)
    long = " ".join(f"long{i}" for i in range(30_000))
    docs = docs_of([(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (2, None, None), (None, "words without an id here", "b"), (3, "", "c"), (4, long, "d"), (5, long + " tail", "e")])
    clashing = ["_p_toxic", "_is_toxic", "_slot", "_word", "_bits", "_probable", "_member", "_hits", "_items", "_n_words", "_drop", "_host", "_n_dropped", "c0", "probable"]
    for k, name in enumerate(clashing):
        docs = docs.withColumn(name, F.concat(F.lit(f"own {k} "), F.coalesce("doc_id", F.lit(0))))
    bench = spark.createDataFrame([(1, "nothing of this is there"), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for kind, rows in (("full", 1), ("empty", 0)):
        bench.limit(rows * 3).write.parquet(f"{folder}/{kind}/benchmark.parquet")
        labels.limit(rows * 3).write.parquet(f"{folder}/{kind}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, f"{folder}/full")
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        got = now.collect()
        assert all(r[n] == f"own {k} {r.doc_id or 0}" for r in got for k, n in enumerate(clashing)), name
        assert sorted(r.doc_id or 0 for r in got) == ([0, 1, 1, 2, 3, 4, 5] if name in ("toxicity", "line_dedup") else [0, 1, 1, 2, 3, 4]), name
        assert stage(spark, docs.where("false"), f"{folder}/empty").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).where("piece = 0").count() == 6
    assert corpus_pipeline.STAGES[-1][1](spark, now.where("false"), folder).count() == 0
