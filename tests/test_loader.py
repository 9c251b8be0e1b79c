import json

import pytest
from pyspark.errors import SparkRuntimeException

from weftgraph.cli import main
from weftgraph.engine import PatternEngine
from weftgraph.plans.pattern import Pattern
from weftgraph.sources.loader import dense_ids, load_graph, malformed_lines, open_graph, read_edges, read_vertices, store_graph
from weftgraph.sources.schema import GraphSchema, SchemaError

#: A graph of 15 vertices and three patterns on it: fixed values, as published, with their counts.
SCHEMA = {
    "vertices": {x: f"{x}.csv" for x in "ABCDE"},
    "edges": {"a": ["A_a_B.csv", "C_a_A.csv"], "b": ["B_b_C.csv", "C_b_D.csv", "D_b_E.csv"]},
    "undirected_edge_labels": [],
}
VERTICES = {"A": [0, 1], "B": [2, 3], "C": [4, 5, 6, 7], "D": [8, 9, 10, 11], "E": [12, 13, 14]}
EDGES = {
    "A_a_B": [(0, 2), (0, 3)],
    "B_b_C": [(2, 6), (3, 7)],
    "C_a_A": [(4, 1), (5, 1), (6, 0), (7, 0)],
    "C_b_D": [(5, 8), (5, 11), (6, 8), (7, 9), (7, 10)],
    "D_b_E": [(8, 12), (9, 14), (10, 13)],
}
PATTERNS = {
    3: ("u0:A; u1:B; u2:C; u3:D; u4:E", "(u0)-[a]->(u1); (u1)-[b]->(u2); (u2)-[a]->(u0); (u2)-[b]->(u3); (u3)-[b]->(u4)", ""),
    2: ("u0:A; u1:B; u2:C", "(u0)-[a]->(u1); (u0)<-[a]-(u2); NOT (u1)-[b]->(u2)", ""),
    6: ("u0:A; u1:C; u2:D", "(u1)-[a]->(u0); OPTIONAL (u1)-[b]->(u2)", ""),
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    for k, ids in VERTICES.items():
        (d / f"{k}.csv").write_text(":ID\n" + "".join(f"{i}|name of {i}\n" for i in ids))
    for k, pairs in EDGES.items():
        (d / f"{k}.csv").write_text(":START_ID|:END_ID\n" + "".join(f"{a}|{b}\n" for a, b in pairs))
    (d / "schema.json").write_text(json.dumps(SCHEMA))
    return d


def test_sample_counts(spark, files):
    for relabel in (False, True):
        engine = PatternEngine(load_graph(spark, GraphSchema.from_json(files / "schema.json"), str(files), relabel=relabel))
        assert engine.count(Pattern.of(*PATTERNS[3])).first()[0] == 3
        assert engine.count(Pattern.of(*PATTERNS[2])).first()[0] == 2
        assert engine.count(Pattern.of(*PATTERNS[6])).first()[0] == 6


def test_store_and_cli(spark, files, tmp_path, capsys):
    target = str(tmp_path / "stored")
    assert main(["build", str(files / "schema.json"), str(files), target, "--relabel"], spark) == 0
    with pytest.raises(Exception, match="(?i)exist"):
        main(["build", str(files / "schema.json"), str(files), target], spark)
    (tmp_path / "q.json").write_text(json.dumps(Pattern.of(*PATTERNS[3]).to_json()))
    capsys.readouterr()
    assert main(["query", target, str(tmp_path / "q.json"), "--cache"], spark) == 0
    assert "matches: 3\n" in capsys.readouterr().out
    main(["summary", target], spark)
    assert "C_b_D" not in capsys.readouterr().out
    g = open_graph(spark, target)
    assert {(r.kind, r.label, r.src_label): r.n for r in g.summary().collect()}[("edge", "b", "C")] == 5
    assert g.stats(("b", "C", "D")).rows == 5


def test_relabel_files(spark, files, tmp_path):
    target = tmp_path / "dense"
    main(["relabel", str(files / "schema.json"), str(files), str(target)], spark)
    assert sorted(r.id for r in read_vertices(spark, str(target / "C.csv")).collect()) == [0, 1, 2, 3]
    assert sorted(map(tuple, read_edges(spark, str(target / "C_b_D.csv")).collect())) == [(1, 0), (1, 3), (2, 0), (3, 1), (3, 2)]


def test_edge_separators(spark, tmp_path):
    (tmp_path / "e.csv").write_text(":START_ID|:END_ID\n1|2\n3,4\n5\t6\n7 8|9\n\n x\n")
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "e.csv"), malformed="skip").collect())) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    (tmp_path / "v.csv").write_text("1\n2|x\n3 4\n\n")
    assert sorted(r.id for r in read_vertices(spark, str(tmp_path / "v.csv"), header=False).collect()) == [1, 2, 3]


def test_header_is_not_looked_at(spark, tmp_path):
    """With a header the first line of each file goes, a number or not; without, it is a line."""
    for i, text in enumerate(("0\n1\n2\n", ":ID\n3\n")):
        (tmp_path / "v.csv").mkdir(exist_ok=True)
        (tmp_path / "v.csv" / f"part-{i}.csv").write_text(text)
    (tmp_path / "e.csv").write_text("0|1\n1|2\n")
    assert sorted(r.id for r in read_vertices(spark, str(tmp_path / "v.csv")).collect()) == [1, 2, 3]
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "e.csv")).collect())) == [(1, 2)]
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "e.csv"), header=False).collect())) == [(0, 1), (1, 2)]
    with pytest.raises(SparkRuntimeException, match="malformed line"):
        read_vertices(spark, str(tmp_path / "v.csv"), header=False).collect()


def test_malformed_lines(spark, tmp_path):
    """Lines without ids and ids that are too large raise, or are left out and counted."""
    bad = ["broken", "99999999999999999999", str(1 << 40), "-", "12x"]
    (tmp_path / "P.csv").write_text(":ID\n0\n1|a\n" + "".join(f"{x}\n" for x in bad))
    (tmp_path / "P_k_P.csv").write_text("from|to\n0|1\n3|x\n1\n1|99999999999999999999\n")
    schema = GraphSchema.from_json({"vertices": {"P": "P.csv"}, "edges": {"k": "P_k_P.csv"}})
    for line in bad:
        (tmp_path / "one.csv").write_text(f"{line}\n")
        with pytest.raises(SparkRuntimeException, match="malformed line"):
            read_vertices(spark, str(tmp_path / "one.csv"), header=False).collect()
    with pytest.raises(SparkRuntimeException, match="malformed line"):
        load_graph(spark, schema, str(tmp_path), dangling="keep").edges("k").collect()
    with pytest.raises(ValueError, match="malformed"):
        read_vertices(spark, str(tmp_path / "P.csv"), malformed="drop")
    g = load_graph(spark, schema, str(tmp_path), malformed="skip")
    assert [r.id for r in g.vertices("P").orderBy("id").collect()] == [0, 1] and g.edges("k").count() == 1
    assert {r.file: r.lines for r in malformed_lines(spark, schema, str(tmp_path)).collect()} == {"P.csv": 5, "P_k_P.csv": 3}


def test_lookups_reach_the_scan(spark, files, tmp_path):
    """Filters on ids of a stored graph are pushed to Parquet, at targets to the copy in their order."""
    store_graph(load_graph(spark, GraphSchema.from_json(files / "schema.json"), str(files)), str(tmp_path / "s"))
    g = open_graph(spark, str(tmp_path / "s"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    at = g.edges_at("b", "src", [5, 7], ["C"])
    assert "PushedFilters: [In(src" in plan(at).replace("IsNotNull(src), ", "")
    assert sorted((r.src & 0xFF, r.dst & 0xFF) for r in at.collect()) == [(5, 8), (5, 11), (7, 9), (7, 10)]
    into = g.edges_at("b", "dst", [8], ["C"])
    assert "EqualTo(dst" in plan(into) or "In(dst" in plan(into)
    assert all(".by_target" in f for f in into.inputFiles()) and all(".by_target" in f for f in g.into("a").inputFiles())
    assert sorted((r.src & 0xFF, r.dst & 0xFF) for r in into.collect()) == [(5, 8), (6, 8)]
    one = g.edges("b").where(f"src = {2 << 40 | 6}")
    assert "EqualTo(src," in plan(one) and one.count() == 1
    with pytest.raises(ValueError, match="out of range"):
        g.edges_at("b", "src", [1 << 40])


def test_adjacency_in_blocks(spark):
    """A hub's neighbours are in several lists; equal neighbours are in lists of one number."""
    from weftgraph.sources.loader import catalog_from_tables

    schema = GraphSchema.from_json({"vertices": {"P": "P.csv"}, "edges": {"k": "P_k_P.csv"}})
    pairs = [(0, i) for i in range(1, 200)] + [(1, i) for i in range(2, 200)] + [(5, 6)]
    g = catalog_from_tables(spark, schema, {"P": spark.range(200)}, {("k", "P", "P"): spark.createDataFrame(pairs, "src long, dst long")})
    rows = g.adjacency("k", most=50).collect()
    assert {r.id for r in rows if len(r.neighbours) > 100} == set() and len([r for r in rows if r.id == 0]) == 4
    assert sorted((r.id, n) for r in rows for n in r.neighbours) == sorted(pairs)
    blocks = {(r.id, n): r.block for r in rows for n in r.neighbours}
    assert all(blocks[0, n] == blocks[1, n] for n in range(2, 200)) and blocks[5, 6] == 0


def test_sets_and_undirected(spark, tmp_path):
    (tmp_path / "P.csv").write_text(":ID\n0\n1\n2\n")
    (tmp_path / "P_k_P.csv").write_text("from|to\n1|0\n0|1\n0|1\n2|2\n")
    schema = GraphSchema.from_json({"vertices": {"P": "P.csv"}, "edges": {"k": "P_k_P.csv"}, "undirected_edge_labels": ["k"]})
    g = load_graph(spark, schema, str(tmp_path))
    assert sorted(map(tuple, g.edges("k").collect())) == [(0, 1), (1, 0), (2, 2)]
    assert load_graph(spark, schema, str(tmp_path), drop_self_loops=True).edges("k").count() == 2
    store_graph(g, str(tmp_path / "s"))
    assert open_graph(spark, str(tmp_path / "s")).edges("k").count() == 3


def test_dangling(spark, tmp_path):
    (tmp_path / "P.csv").write_text(":ID\n0\n1\n")
    (tmp_path / "P_k_P.csv").write_text("from|to\n0|1\n0|9\n")
    schema = GraphSchema.from_json({"vertices": {"P": "P.csv"}, "edges": {"k": "P_k_P.csv"}})
    for relabel in (False, True):
        with pytest.raises(SparkRuntimeException, match="without a vertex"):
            load_graph(spark, schema, str(tmp_path), relabel=relabel).edges("k").collect()
        assert load_graph(spark, schema, str(tmp_path), relabel=relabel, dangling="drop").edges("k").count() == 1
    kept = load_graph(spark, schema, str(tmp_path), dangling="keep")
    assert kept.edges("k").count() == 2 and kept.dangling().count() == 1


@pytest.mark.parametrize(
    "spec",
    [
        {"vertices": {}},
        {"vertices": {"A": "A.csv"}, "edges": {"x": "nonsense.csv"}},
        {"vertices": {"A": "A.csv"}, "edges": {"x": "A_x_B.csv"}},
        {"vertices": {"A": {"B": {"C": "C.csv"}}}, "edges": {}},
        {"vertices": {"A": "A.csv"}, "edges": {"x": "A_x_A.csv"}, "undirected_edge_labels": ["y"]},
    ],
)
def test_bad_schemas(spec):
    with pytest.raises(SchemaError):
        GraphSchema.from_json(spec)


def test_schema_round_trip():
    spec = {"vertices": {"M": {"A": "A.csv", "B": "B.csv"}, "C": "C.csv"}, "edges": {"x": ["A_x_C.csv", "B_x_C.csv"], "k": "C_k_C.csv"}, "undirected_edge_labels": ["k"]}
    s = GraphSchema.from_json(spec)
    assert s.leaves_of("M") == ["A", "B"] and s.ordered_leaves == ["A", "B", "C"]
    assert GraphSchema.from_json(s.to_json()) == s
