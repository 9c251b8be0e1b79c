from collections import Counter

from pyspark.sql import functions as F

from weftgraph.llm.line_dedup import line_dedup


def brute(rows, ratio, least):
    total, on = Counter(), Counter()
    for _, text, host in rows:
        total[host or ""] += 1
        on.update({(host or "", x.strip(" \t\r")) for x in (text or "").split("\n") if x.strip(" \t\r")})
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None))
            continue
        drop = lambda x: on[(host or "", x.strip(" \t\r"))] >= least and on[(host or "", x.strip(" \t\r"))] > ratio * total[host or ""]
        out.append((i, "\n".join(x for x in text.split("\n") if not drop(x))))
    return out


ROWS = [(i, f"  menu \nline {i}\n\nmenu\nshared {i % 2}", "a") for i in range(10)]
ROWS += [(20 + i, f"menu\nbody {i}", "b") for i in range(4)]
ROWS += [(30, None, "a"), (31, "", "a"), (32, "menu", None), (33, "menu\n" * 50, "c"), (34, "menu", "b"), (34, "menu", "b")]


def test_against_brute_force(docs_of):
    for limit in (0, 1000):
        got = sorted((r.doc_id, r.text) for r in line_dedup(docs_of(ROWS), F.col("source"), ratio=0.4, min_pages=3, broadcast_lines=limit).collect())
        assert got == sorted(brute(ROWS, 0.4, 3), key=lambda r: (r[0], r[1] or ""))


def test_columns_and_empty(docs_of):
    df = docs_of([(1, "a", "h")]).withColumn("line", F.lit(1)).withColumn("_x", F.lit(2))
    out = line_dedup(df, F.col("source"))
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"] and out.first()["text"] == "a"
    clashing = ["_drop", "_host", "_keys", "_kept", "_n_lines", "_N_DROPPED", "host", "drop", "keys", "hits", "n", "buckets", "kept", "n_lines", "part", "c0", "c1"]
    df = docs_of(ROWS)
    for k, name in enumerate(clashing):
        df = df.withColumn(name, F.concat(F.lit(f"own {k} "), "doc_id"))
    for limit in (0, 1000):
        out = line_dedup(df, F.col("source"), ratio=0.4, min_pages=3, broadcast_lines=limit)
        assert out.columns == [*df.columns, "_n_lines_", "_n_dropped_"]
        got = out.collect()
        assert all(r[name] == f"own {k} {r.doc_id}" for r in got for k, name in enumerate(clashing))
        assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(ROWS, 0.4, 3), key=lambda r: (r[0], r[1] or ""))
    assert line_dedup(df.where("false"), F.col("source")).count() == 0


def test_counts(docs_of):
    rows = {r.doc_id: (r._n_lines, r._n_dropped) for r in line_dedup(docs_of(ROWS), F.col("source"), ratio=0.4, min_pages=3).collect()}
    assert rows[0] == (5, 3) and rows[30] == (0, 0) and rows[31] == (1, 0) and rows[20] == (2, 1)


def dropped_by_host(spark, docs_of, tmp_path, hosts):
    """Pages on which the registered query drops a line, for hosts {name: (pages, pages with the line)}."""
    from weftgraph.llm import registry

    rows, i = [], 0
    for host, (pages, having) in hosts.items():
        for k in range(pages):
            rows.append((i, f"body {i}" + ("\nall rights" if k < having else ""), host))
            i += 1
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    source = {r[0]: r[2] for r in rows}
    got = Counter()
    for r in registry.queries()["op10_line_dedup"](spark, str(tmp_path)).collect():
        got[source[r.doc_id]] += r.n_dropped
        assert r.text.startswith("body") and not (r.n_dropped and "all rights" in r.text)
    return got


def test_small_and_large_hosts(spark, docs_of, tmp_path):
    """The same share goes on a site of any size; what is on one page only is no boilerplate."""
    hosts = {"ten": (10, 3), "two of ten": (10, 2), "one of ten": (10, 1), "fifty": (50, 11), "large": (500, 66), "every page": (4, 4), "only page": (1, 1), "ordinary": (500, 24)}
    assert dropped_by_host(spark, docs_of, tmp_path, hosts) == {"ten": 3, "two of ten": 2, "one of ten": 0, "fifty": 11, "large": 66, "every page": 4, "only page": 0, "ordinary": 0}


def test_ratio_between_boilerplate_and_other_lines(spark, docs_of, tmp_path):
    """Shares of the boilerplate line and of the most frequent other line, as measured at sf0.1."""
    hosts = {"least": (500, 43), "most": (500, 66), "other line": (500, 24)}
    assert dropped_by_host(spark, docs_of, tmp_path, hosts) == {"least": 43, "most": 66, "other line": 0}


def test_long_page_and_hot_site(docs_of, monkeypatch):
    """A page of very many boilerplate lines, in a site that is dealt to several tasks."""
    from weftgraph.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_PAGES", 4)
    monkeypatch.setattr(module, "HOT_SITES", 3)
    long = "\n".join(f"menu {k}" for k in range(3000))
    rows = [(i, f"{long}\nbody {i}" if i < 3 else f"menu 7\nbody {i}", "a") for i in range(20)] + [(30, "x" * 300_000 + "\nmenu 7", "b"), (31, "x" * 300_000, "b"), (32, "tie", "c"), (33, "tie\nz", "c"), (34, "y", "c"), (35, "w", "c")]
    for limit in (0, 10**6):
        got = {r.doc_id: r.text for r in line_dedup(docs_of(rows), F.col("source"), ratio=0.1, broadcast_lines=limit).collect()}
        assert got == dict(brute(rows, 0.1, 2)) and got[0] == "body 0" and got[31] == ""
        tied = {r.doc_id: r._n_dropped for r in line_dedup(docs_of(rows), F.col("source"), ratio=0.5, broadcast_lines=limit).collect()}
        assert tied[32] == tied[33] == 0
