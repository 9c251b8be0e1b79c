"""Patterns under every strategy against a matcher that tries everything."""

import random

import pytest
from tests.brute import matches

from weftgraph.engine import PatternEngine
from weftgraph.plans.compiler import STRATEGIES
from weftgraph.plans.pattern import Pattern, PatternError
from weftgraph.sources.loader import catalog_from_tables
from weftgraph.sources.schema import EdgeTable, GraphSchema

LEAVES = ["A", "B", "C"]
EDGES = [("x", "A", "B"), ("x", "B", "B"), ("y", "B", "C"), ("y", "C", "A"), ("k", "A", "A"), ("z", "A", "C"), ("none", "A", "B")]


def make(spark, seed):
    r = random.Random(seed)
    schema = GraphSchema({x: f"{x}.csv" for x in LEAVES}, {"M": ["A", "B"]}, [EdgeTable(*e) for e in EDGES], {"k"})
    ids = {x: list(range(r.randint(3, 5))) for x in LEAVES}
    raw = {}
    for e in EDGES:
        n = 0 if e[0] == "none" else r.randint(4, 9)
        # Repeats, and loops where both ends have one label.
        raw[e] = [(r.choice(ids[e[1]]), r.choice(ids[e[2]])) for _ in range(n)]
    vertices = {x: spark.createDataFrame([(i,) for i in v], "id long") for x, v in ids.items()}
    g = catalog_from_tables(spark, schema, vertices, {e: spark.createDataFrame(p, "src long, dst long") for e, p in raw.items()})
    all_v = {x: [(x, i) for i in v] for x, v in ids.items()}
    all_v["M"] = all_v["A"] + all_v["B"]
    all_e: dict = {}
    for (label, s, d), pairs in raw.items():
        own = all_e.setdefault(label, set())
        for a, b in pairs:
            own.add(((s, a), (d, b)))
            if label in schema.undirected:
                own.add(((d, b), (s, a)))
    return g, all_v, all_e


CASES = {
    "edge": ("a:A; b:B", "(a)-[x]->(b)", ""),
    "incoming": ("a:A; c:C", "(a)<-[y]-(c)", ""),
    "chain": ("a:A; b:B; c:C", "(a)-[x]->(b); (b)-[y]->(c)", ""),
    "triangle": ("a:A; b:A; c:A", "(a)-[k]->(b); (b)-[k]->(c); (c)-[k]->(a)", ""),
    "triangle_and_tail": ("a:A; b:B; c:C; d:C", "(a)-[x]->(b); (b)-[y]->(c); (c)-[y]->(a); (a)-[z]->(d)", ""),
    "parallel": ("a:A; c:C", "(a)-[z]->(c); (c)-[y]->(a)", ""),
    "undirected": ("a:A; c:C", "(a)-[z]-(c)", ""),
    "undirected_bag": ("a:M; b:M", "(a)-[x]-(b)", ""),
    "undirected_label": ("a:A; b:A; c:C", "(a)-[k]-(b); (b)-[z]->(c)", ""),
    "super": ("m:M; b:B; c:C", "(m)-[x]->(b); (b)-[y]->(c)", ""),
    "super_both": ("m:M; n:M", "(m)-[x]->(n)", ""),
    "neq": ("a:A; b:B; d:B; c:C", "(a)-[x]->(b); (a)-[x]->(d); (b)-[y]->(c)", "b<>d"),
    "neq_super": ("m:M; n:M; b:B", "(m)-[x]->(b); (n)-[x]->(b)", "m<>n"),
    "two_neq": ("a:A; b:A; c:A; d:A", "(a)-[k]->(b); (b)-[k]->(c); (c)-[k]->(d)", "a<>c; b<>d"),
    "not": ("a:A; b:B; c:C", "(a)-[x]->(b); (b)-[y]->(c); NOT (a)-[z]->(c)", ""),
    "not_none": ("a:A; b:B", "(a)-[x]->(b); NOT (a)-[none]->(b)", ""),
    "not_no_table": ("a:A; b:B; c:C", "(a)-[x]->(b); (b)-[y]->(c); NOT (c)-[x]->(b)", ""),
    "not_neq": ("a:A; b:A; c:A", "(a)-[k]->(b); (b)-[k]->(c); NOT (a)-[k]->(c)", "a<>c"),
    "not_cyclic": ("a:A; b:B; c:C", "(a)-[x]->(b); (b)-[y]->(c); (c)-[y]->(a); NOT (a)-[z]->(c)", ""),
    "empty": ("a:A; b:B; c:C", "(a)-[none]->(b); (b)-[y]->(c)", ""),
    "disconnected": ("a:A; b:B; c:C; d:A", "(a)-[x]->(b); (d)-[z]->(c)", ""),
    "disconnected_neq": ("a:A; b:B; c:C; d:A", "(a)-[x]->(b); (d)-[z]->(c)", "a<>d"),
    "optional": ("a:A; b:B; c:C", "(a)-[x]->(b); OPTIONAL (b)-[y]->(c)", ""),
    "optional_none": ("a:A; b:B; d:B", "(a)-[x]->(b); OPTIONAL (a)-[none]->(d)", ""),
    "optional_two": ("a:A; b:B; c:C; d:C", "(a)-[x]->(b); OPTIONAL (b)-[y]->(c); OPTIONAL (a)-[z]->(d)", ""),
    "optional_same_vertex": ("a:A; b:B; c:C", "(a)-[x]->(b); OPTIONAL (b)-[y]->(c); OPTIONAL (a)-[z]->(c)", ""),
    "optional_chain": ("a:A; b:B; c:C; d:A", "(a)-[x]->(b); OPTIONAL (b)-[y]->(c); OPTIONAL (c)-[y]->(d)", ""),
    "optional_neq": ("a:A; b:A; c:A", "(a)-[k]->(b); OPTIONAL (b)-[k]->(c)", "a<>c"),
    "optional_neq_optional": ("a:A; b:A; c:A; d:A", "(a)-[k]->(b); OPTIONAL (b)-[k]->(c); OPTIONAL (a)-[k]->(d)", "c<>d"),
    "optional_neq_chain": ("a:A; b:B; c:C; d:A", "(a)-[x]->(b); OPTIONAL (b)-[y]->(c); OPTIONAL (c)-[y]->(d)", "a<>d"),
    "optional_not": ("a:A; b:B; c:C; d:C", "(a)-[x]->(b); (b)-[y]->(c); NOT (a)-[z]->(c); OPTIONAL (a)-[z]->(d)", ""),
    "optional_super": ("b:B; m:M; c:C", "(b)-[y]->(c); OPTIONAL (m)-[x]->(b)", ""),
    "case_only_names": ("a:A; A:B; b:C", "(a)-[x]->(A); (A)-[y]->(b)", ""),
}


@pytest.fixture(scope="module")
def graphs(spark):
    return [make(spark, s) for s in (1, 2)]


@pytest.mark.parametrize("name", CASES)
def test_counts(graphs, name):
    p = Pattern.of(*CASES[name])
    for g, v, e in graphs[: 1 if name.startswith("undirected") else 2]:
        want = matches(p, v, e, {"x", "y", "z"})
        engine = PatternEngine(g)
        plans = [engine.count(p, s) for s in STRATEGIES]
        got = plans[0]
        for other in plans[1:]:
            got = got.unionByName(other)
        assert [r.match_count for r in got.collect()] == [len(want)] * len(STRATEGIES), name


@pytest.mark.parametrize("name", ["triangle_and_tail", "super_both", "neq_super", "not_neq", "optional_same_vertex", "optional_chain", "optional_neq_optional", "case_only_names"])
def test_bindings(graphs, name):
    p = Pattern.of(*CASES[name])
    g, v, e = graphs[1]
    want = matches(p, v, e, set())
    engine = PatternEngine(g)
    names = [x.name for x in p.vertices]
    supers = {x.name for x in p.vertices if x.label == "M"}
    shape = lambda m: tuple((m[n] if n in supers else m[n] and m[n][1] if m[n] else None) for n in names)
    rows = [tuple(r) for r in engine.match(p).collect()]
    flat = []
    for r in rows:
        r, out = list(r), []
        for n in names:
            i = r.pop(0)
            out.append((r.pop(0), i) if n in supers else i)
        flat.append(tuple(out))
    assert sorted(map(repr, flat)) == sorted(repr(shape(m)) for m in want)
    first = names[0]
    counts: dict = {}
    for m in want:
        counts[m[first]] = counts.get(m[first], 0) + 1
    assert sorted(r.match_count for r in engine.match_counts(p, [first]).collect()) == sorted(counts.values())


def test_errors(graphs):
    engine = PatternEngine(graphs[0][0])
    with pytest.raises(PatternError, match="vertex label"):
        engine.count(Pattern.of("a:Z; b:B", "(a)-[x]->(b)"))
    with pytest.raises(PatternError, match="edge label"):
        engine.count(Pattern.of("a:A; b:B", "(a)-[Z]->(b)"))
    with pytest.raises(ValueError, match="strategy"):
        engine.count(Pattern.of("a:A; b:B", "(a)-[x]->(b)"), "guess")


def test_choice(graphs, monkeypatch):
    from weftgraph.plans import compiler

    engine = PatternEngine(graphs[0][0])
    text = engine.explain(Pattern.of(*CASES["neq"]))
    assert "strategy: eager" in text and "HashAggregate" in text
    monkeypatch.setattr(compiler, "LARGE", 1.0)
    names = ("neq", "not", "triangle", "optional_neq", "two_neq")
    choice = {n: engine.compile(Pattern.of(*CASES[n])).choose() for n in names}
    assert choice == {"neq": "subtract", "not": "eager", "triangle": "eager", "optional_neq": "eager", "two_neq": "subtract"}
    monkeypatch.setattr(compiler, "SKEWED", 1.0)
    choice = {n: engine.compile(Pattern.of(*CASES[n])).choose() for n in ("neq", "not", "triangle", "optional_neq", "two_neq")}
    assert choice == {"neq": "subtract", "not": "subtract", "triangle": "intersect", "optional_neq": "eager", "two_neq": "subtract"}


def test_hubs_are_told_from_equal_degrees(spark):
    """Triangles are closed from the end with fewer neighbours where edges have hubs."""
    from weftgraph.plans import compiler

    schema = GraphSchema({"P": "P.csv"}, {}, [EdgeTable("k", "P", "P")], {"k"})
    ring = [(i, (i + s) % 400) for i in range(400) for s in (1, 2)]
    hubs = [*ring, *[(h, i) for h in (0, 7) for i in range(400) if i != h]]
    p = Pattern.of("a:P; b:P; c:P", "(a)-[k]->(b); (b)-[k]->(c); (c)-[k]->(a)")
    for pairs, skewed in ((ring, False), (hubs, True)):
        g = catalog_from_tables(spark, schema, {"P": spark.range(400)}, {("k", "P", "P"): spark.createDataFrame(pairs, "src long, dst long")})
        assert (g.skew(("k", "P", "P")) >= compiler.SKEWED) == skewed
        both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
        near = {}
        for a, b in both:
            near.setdefault(a, set()).add(b)
        want = sum(len(near[a] & near[b]) for a, b in both)
        engine = PatternEngine(g)
        assert [engine.count(p, s).first()[0] for s in ("eager", "intersect")] == [want, want]
