from pyspark.sql import functions as F

from weftgraph.llm.exact_dedup import exact_dedup


def result(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_groups(docs_of):
    long = "x" * 5000
    rows = [(1, "Hello World"), (2, "hello world"), (3, "hello worle"), (4, None), (5, ""), (6, long + "a"), (7, long + "b"), (8, long.upper() + "A"), (9, "É"), (10, "é"), (11, "lone")]
    assert result(exact_dedup(docs_of(rows))) == [
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 8, 2, False), (7, 7, 1, True), (8, 8, 2, True), (9, 9, 1, True), (10, 10, 1, True), (11, 11, 1, True),
    ]


def test_repeated_rows_and_null_ids(docs_of):
    got = exact_dedup(docs_of([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (None, "c")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup(df)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 2997").count() == 1000


def test_empty_and_carry(docs_of):
    assert exact_dedup(docs_of([(1, "a")]).where("false")).count() == 0
    df = docs_of([(1, "a"), (2, "a")]).withColumn("keep_id", F.lit("clash")).withColumn("kept", F.lit(0))
    got = exact_dedup(df, carry={"old": F.col("keep_id")}).collect()
    assert {(r.doc_id, r.keep_id, r.old) for r in got} == {(1, 2, "clash"), (2, 2, "clash")}


def test_no_python_in_plan(docs_of):
    plan = exact_dedup(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_very_long_and_tied_prefixes(docs_of):
    """Texts of a megabyte that differ in the last character, and equal lengths with unequal prefixes."""
    long = "ab" * 500_000
    rows = [(1, long + "x"), (2, long + "y"), (3, (long + "x").upper()), (4, "p" * 300), (5, "q" * 300), (6, "p" * 299 + "q"), (7, "P" * 300)]
    assert [r[:3] for r in result(exact_dedup(docs_of(rows)))] == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 7, 2), (5, 5, 1), (6, 6, 1), (7, 7, 2)]


def test_each_step_reads_only_what_the_one_before_left(docs_of, monkeypatch):
    """Prefixes are hashed behind the filter of repeated lengths, and full texts behind that of
    repeated prefixes."""
    from weftgraph.llm import exact_dedup as module

    plans, save = {}, module.Scratch.save

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(module.Scratch, "save", noted)
    rows = [(1, "aa"), (2, "ab"), (3, "abc"), (4, "aa")]
    assert [r[:3] for r in result(exact_dedup(docs_of(rows)))] == [(1, 4, 2), (2, 2, 1), (3, 3, 1), (4, 4, 2)]
    assert "xxhash64(substring" not in plans["lengths"] and "sha2" not in plans["lengths"] + plans["prefixes"]
    lines = plans["prefixes"].splitlines()
    hashed = next(i for i, x in enumerate(lines) if "xxhash64(substring" in x)
    probe = next(i for i, x in enumerate(lines) if "Join" in x)
    assert hashed < probe and any("Filter" in x for x in lines[hashed:probe])
    assert "CASE WHEN _longer" in plans["full-hashes"] and "CASE WHEN _again" in plans["full-hashes"]
