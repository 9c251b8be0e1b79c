"""Registered pattern queries over the star graph, each with SQL written by hand from the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.engine import PatternEngine
from weftgraph.functions.ids import label_of, raw_id
from weftgraph.operators.relation import Relation, intersect_neighbours
from weftgraph.plans.pattern import Pattern
from weftgraph.sources.catalog import GraphCatalog
from weftgraph.sources.loader import catalog_from_tables, dense_ids, load_graph, open_graph, read_edges, relabel_files, store_graph
from weftgraph.sources.schema import EdgeTable, GraphSchema
from weftgraph.sources.shared import Scratch
from weftgraph.sources.tabular import star_graph

_GRAPHS: dict[tuple[str, str], GraphCatalog] = {}


def graph(spark: SparkSession, folder: str) -> GraphCatalog:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _GRAPHS:
        _GRAPHS[key] = star_graph(spark, folder)
    return _GRAPHS[key]


#: name: (vertices, edges, constraints)
PATTERNS: dict[str, tuple[str, str, str]] = {
    "g1_chain": ("n:Nation; c:Customer; o:Order; p:Part", "(c)-[IN_NATION]->(n); (c)-[PLACED]->(o); (o)-[CONTAINS]->(p)", ""),
    "g2_cycle": ("c:Customer; o:Order; s:Supplier; n:Nation", "(c)-[PLACED]->(o); (o)-[SUPPLIED_BY]->(s); (c)-[IN_NATION]->(n); (s)-[IN_NATION]->(n)", ""),
    "g3_triangle": (
        "n:Nation; a:Customer; b:Customer; c:Customer",
        "(a)-[KNOWS]->(b); (b)-[KNOWS]->(c); (c)-[KNOWS]->(a); (a)-[IN_NATION]->(n); (b)-[IN_NATION]->(n); (c)-[IN_NATION]->(n)",
        "",
    ),
    "g4_star": ("o:Order; c:Customer; p:Part; s:Supplier", "(c)-[PLACED]->(o); (o)-[CONTAINS]->(p); (o)-[SUPPLIED_BY]->(s)", ""),
    "g5_neq": (
        "o:Order; p:Part; q:Part; s:Supplier; c:Customer",
        "(o)-[CONTAINS]->(p); (o)-[CONTAINS]->(q); (o)-[SUPPLIED_BY]->(s); (c)-[PLACED]->(o)",
        "p<>q",
    ),
    "g6_twohop": ("a:Customer; b:Customer; c:Customer; t:EventType", "(a)-[KNOWS]->(b); (b)-[KNOWS]->(c); (c)-[HAS_INTEREST]->(t)", "a<>c"),
    "g7_optional": ("c:Customer; o:Order; p:Part; s:Supplier", "(c)-[PLACED]->(o); OPTIONAL (o)-[CONTAINS]->(p); OPTIONAL (o)-[SUPPLIED_BY]->(s)", ""),
    "g8_not": ("o:Order; p:Part; s:Supplier", "(o)-[CONTAINS]->(p); (o)-[SUPPLIED_BY]->(s); NOT (s)-[SUPPLIES]->(p)", ""),
    "g9_not_knows": (
        "a:Customer; b:Customer; c:Customer; t:EventType",
        "(a)-[KNOWS]->(b); (b)-[KNOWS]->(c); (c)-[HAS_INTEREST]->(t); NOT (a)-[KNOWS]->(c)",
        "a<>c",
    ),
    "p2_directed_edge": ("c:Customer; o:Order", "(c)-[PLACED]->(o)", ""),
    "p3_incoming_edge": ("p:Part; o:Order; c:Customer", "(p)<-[CONTAINS]-(o); (o)<-[PLACED]-(c)", ""),
    "p4_undirected_edge": ("x:Party; y:Nation; z:Party", "(x)-[IN_NATION]-(y); (y)-[IN_NATION]-(z)", ""),
    "p4_undirected_on_undirected": ("a:Customer; b:Customer; t:EventType", "(a)-[KNOWS]-(b); (b)-[HAS_INTEREST]->(t)", ""),
    "p9_super_label": ("x:Party; n:Nation; r:Region", "(x)-[IN_NATION]->(n); (n)-[IN_REGION]->(r)", ""),
    "f1_neq_super_label": ("x:Party; y:Party; n:Nation", "(x)-[IN_NATION]->(n); (y)-[IN_NATION]->(n)", "x<>y"),
    "f4_multi_file_union": ("x:Party; n:Nation", "(x)-[IN_NATION]->(n)", ""),
    "j1_four_cycle_parts": ("o:Order; p:Part; s:Supplier", "(o)-[CONTAINS]->(p); (o)-[SUPPLIED_BY]->(s); (s)-[SUPPLIES]->(p)", ""),
    "j5_not_neq": ("o:Order; p:Part; q:Part; s:Supplier", "(o)-[CONTAINS]->(p); (o)-[CONTAINS]->(q); (o)-[SUPPLIED_BY]->(s); NOT (s)-[SUPPLIES]->(q)", "p<>q"),
    "j6_optional_neq": ("c:Customer; n:Nation; d:Customer", "(c)-[IN_NATION]->(n); OPTIONAL (c)-[KNOWS]->(d)", "c<>d"),
    "j6_optional_two_edges": ("c:Customer; n:Nation; d:Customer", "(c)-[IN_NATION]->(n); OPTIONAL (c)-[KNOWS]->(d); OPTIONAL (d)-[IN_NATION]->(n)", ""),
    "j8_cross_product": ("n:Nation; r:Region; c:Customer; t:EventType", "(n)-[IN_REGION]->(r); (c)-[HAS_INTEREST]->(t)", ""),
    "j16_optional_not": ("o:Order; p:Part; s:Supplier; c:Customer", "(o)-[CONTAINS]->(p); (o)-[SUPPLIED_BY]->(s); NOT (s)-[SUPPLIES]->(p); OPTIONAL (c)-[PLACED]->(o)", ""),
    "j3_chained_optional": ("c:Customer; n:Nation; t:Customer; e:EventType", "(c)-[IN_NATION]->(n); OPTIONAL (c)-[KNOWS]->(t); OPTIONAL (t)-[HAS_INTEREST]->(e)", ""),
}

#: name: (pattern, variables to count by)
BINDINGS: dict[str, tuple[str, list[str]]] = {
    "g1_chain_by_nation": ("g1_chain", ["n"]),
    "g3_triangle_by_nation": ("g3_triangle", ["n"]),
    "g4_star_by_supplier": ("g4_star", ["s"]),
    "g5_neq_by_supplier": ("g5_neq", ["s"]),
    "g6_twohop_by_type": ("g6_twohop", ["t"]),
    "g7_optional_by_supplier": ("g7_optional", ["s"]),
    "g8_not_by_supplier": ("g8_not", ["s"]),
    "g9_not_knows_by_customer": ("g9_not_knows", ["c"]),
    "p9_super_label_by_region": ("p9_super_label", ["r"]),
    "f1_neq_super_label_by_party": ("f1_neq_super_label", ["x"]),
    "j3_chained_optional_by_type": ("j3_chained_optional", ["e"]),
}

#: Patterns counted in other ways than the engine chooses.
STRATEGIES: dict[str, tuple[str, str]] = {
    "j7_table_join_star": ("g4_star", "declared"),
    "j7_table_join_cycle": ("g2_cycle", "declared"),
    "j1_join_chain": ("g1_chain", "join"),
    "j2_join_neq": ("g5_neq", "join"),
    "j4_join_not": ("g8_not", "join"),
    "j9_semi_join_cycle": ("g2_cycle", "reduce"),
    "j11_eager_star": ("g4_star", "eager"),
    "j11_subtract_neq": ("g5_neq", "subtract"),
    "j11_subtract_not": ("g8_not", "subtract"),
    "j10_intersect_triangle": ("g3_triangle", "intersect"),
    "j10_intersect_supplies": ("j1_four_cycle_parts", "intersect"),
}

_CONTAINS = "(SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
_SUPPLIED = "(SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)"
_SUPPLIES = "(SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)"
_PARTY = "(SELECT 'Customer' AS kind, c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_nationkey FROM supplier)"
_WITH = """WITH bought AS (SELECT DISTINCT l_partkey, s_nationkey, o_custkey FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
knows AS (SELECT DISTINCT x.o_custkey AS a, y.o_custkey AS b FROM bought x
  JOIN bought y ON x.l_partkey = y.l_partkey AND x.s_nationkey = y.s_nationkey AND x.o_custkey <> y.o_custkey),
types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
interest AS (SELECT DISTINCT user_id AS c, id AS t FROM events JOIN types USING (event_type) WHERE value > 150)
"""

#: name: FROM and WHERE of the matches, with what its variables are; some start with WITH.
_MATCHES: dict[str, tuple[bool, str, dict[str, str]]] = {
    "g1_chain": (False, f"customer JOIN orders ON o_custkey = c_custkey JOIN {_CONTAINS} l ON l.o = o_orderkey", {"n": "c_nationkey"}),
    "g2_cycle": (False, f"orders JOIN customer ON o_custkey = c_custkey JOIN {_SUPPLIED} l ON l.o = o_orderkey JOIN supplier ON s_suppkey = l.s AND s_nationkey = c_nationkey", {}),
    "g3_triangle": (
        True,
        "knows k1 JOIN customer x ON x.c_custkey = k1.a JOIN customer y ON y.c_custkey = k1.b AND y.c_nationkey = x.c_nationkey "
        "JOIN knows k2 ON k2.a = k1.b JOIN customer z ON z.c_custkey = k2.b AND z.c_nationkey = x.c_nationkey JOIN knows k3 ON k3.a = k2.b AND k3.b = k1.a",
        {"n": "x.c_nationkey"},
    ),
    "g4_star": (False, f"orders JOIN {_CONTAINS} l ON l.o = o_orderkey JOIN {_SUPPLIED} m ON m.o = o_orderkey", {"s": "m.s"}),
    "g5_neq": (False, f"orders JOIN {_CONTAINS} l ON l.o = o_orderkey JOIN {_CONTAINS} k ON k.o = o_orderkey AND k.p <> l.p JOIN {_SUPPLIED} m ON m.o = o_orderkey", {"s": "m.s"}),
    "g6_twohop": (True, "knows k1 JOIN knows k2 ON k2.a = k1.b AND k2.b <> k1.a JOIN interest i ON i.c = k2.b", {"t": "i.t"}),
    "g7_optional": (False, f"orders LEFT JOIN {_CONTAINS} l ON l.o = o_orderkey LEFT JOIN {_SUPPLIED} m ON m.o = o_orderkey", {"s": "m.s"}),
    "g8_not": (False, f"{_CONTAINS} l JOIN {_SUPPLIED} m ON m.o = l.o WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = m.s AND x.l_partkey = l.p)", {"s": "m.s"}),
    "g9_not_knows": (
        True,
        "knows k1 JOIN knows k2 ON k2.a = k1.b AND k2.b <> k1.a JOIN interest i ON i.c = k2.b WHERE NOT EXISTS (SELECT 1 FROM knows k3 WHERE k3.a = k1.a AND k3.b = k2.b)",
        {"c": "k2.b"},
    ),
    "p2_directed_edge": (False, "orders", {}),
    "p3_incoming_edge": (False, f"{_CONTAINS} l JOIN orders ON o_orderkey = l.o", {}),
    "p4_undirected_edge": (False, f"{_PARTY} x JOIN {_PARTY} z ON x.n = z.n", {}),
    "p4_undirected_on_undirected": (True, "knows k JOIN interest i ON i.c = k.b", {}),
    "p9_super_label": (False, f"{_PARTY} x JOIN nation ON n_nationkey = x.n", {"r": "n_regionkey"}),
    "f1_neq_super_label": (False, f"{_PARTY} x JOIN {_PARTY} y ON x.n = y.n AND NOT (x.kind = y.kind AND x.id = y.id)", {"x": "x.id", "x_label": "x.kind"}),
    "f4_multi_file_union": (False, f"{_PARTY} x", {}),
    "j1_four_cycle_parts": (False, f"{_CONTAINS} l JOIN {_SUPPLIED} m ON m.o = l.o JOIN {_SUPPLIES} t ON t.s = m.s AND t.p = l.p", {}),
    "j5_not_neq": (
        False,
        f"{_CONTAINS} l JOIN {_CONTAINS} k ON k.o = l.o AND k.p <> l.p JOIN {_SUPPLIED} m ON m.o = l.o WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = m.s AND x.l_partkey = k.p)",
        {},
    ),
    "j6_optional_neq": (True, "customer LEFT JOIN knows k ON k.a = c_custkey AND k.b <> c_custkey", {}),
    "j6_optional_two_edges": (True, "customer x LEFT JOIN (SELECT a, b, c_nationkey AS n FROM knows JOIN customer ON c_custkey = b) k ON k.a = x.c_custkey AND k.n = x.c_nationkey", {}),
    "j8_cross_product": (True, "nation CROSS JOIN interest", {}),
    "j16_optional_not": (
        False,
        f"{_CONTAINS} l JOIN {_SUPPLIED} m ON m.o = l.o LEFT JOIN orders ON o_orderkey = l.o WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = m.s AND x.l_partkey = l.p)",
        {},
    ),
    "j3_chained_optional": (True, "customer LEFT JOIN knows k ON k.a = c_custkey LEFT JOIN interest i ON i.c = k.b", {"e": "i.t"}),
}


def _count_sql(name: str) -> str:
    with_, body, _ = _MATCHES[name]
    return f"{_WITH if with_ else ''}SELECT count(*) AS match_count FROM {body}"


def _binding_sql(name: str) -> str:
    pattern, names = BINDINGS[name]
    with_, body, vars_ = _MATCHES[pattern]
    columns = [v for v in vars_ if v in names or v.removesuffix("_label") in names]
    keys = ", ".join(vars_[v] for v in columns)
    shown = ", ".join(vars_[v] if v.endswith("_label") else f"CAST({vars_[v]} AS BIGINT)" for v in columns)
    shown = ", ".join(f"{s} AS {v}" for s, v in zip(shown.split(", "), columns, strict=True))
    return f"{_WITH if with_ else ''}SELECT {shown}, count(*) AS match_count FROM {body} GROUP BY {keys}"


# Whole-graph operators


def _raw(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[raw_id(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _renumbered(spark: SparkSession, folder: str) -> DataFrame:
    """Global ids of all vertices, which have a gap after each label."""
    g = graph(spark, folder)
    ids = g.vertices(_LABELS[0])
    for x in _LABELS[1:]:
        ids = ids.unionByName(g.vertices(x))
    return dense_ids(ids)


def _files(spark: SparkSession, folder: str) -> tuple[GraphSchema, str]:
    """Customers, orders and what connects them as CSV files with headers, and their schema. Order
    keys are spread so that numbering them anew changes them."""
    read = lambda t, *columns: spark.read.parquet(f"{folder}/{t}.parquet").select(*columns)
    spread = F.col("o_orderkey") * 7 + 3
    tables = {
        "Customer": read("customer", F.col("c_custkey").alias(":ID"), "c_name"),
        "Order": read("orders", spread.alias(":ID"), "o_orderstatus"),
        "Nation": read("nation", F.col("n_nationkey").alias(":ID"), "n_name"),
        "Customer_PLACED_Order": read("orders", F.col("o_custkey").alias(":START_ID"), spread.alias(":END_ID")),
        "Customer_IN_NATION_Nation": read("customer", F.col("c_custkey").alias(":START_ID"), F.col("c_nationkey").alias(":END_ID")),
    }
    schema = GraphSchema.from_json({"vertices": {x: f"{x}.csv" for x in ("Customer", "Order", "Nation")}, "edges": {"PLACED": "Customer_PLACED_Order.csv", "IN_NATION": "Customer_IN_NATION_Nation.csv"}})
    path = f"{Scratch(spark).path}/csv"
    for name, t in tables.items():
        t.write.csv(f"{path}/{name}.csv", sep="|", header=True)
    return schema, path


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of both labels from CSV files with headers, by the files' ids."""
    schema, path = _files(spark, folder)
    g = load_graph(spark, schema, path)
    return _raw(g.edges("PLACED").withColumn("label", F.lit("PLACED")).unionByName(g.edges("IN_NATION").withColumn("label", F.lit("IN_NATION"))), "src", "dst")


def _relabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of CSV files that were written again with dense ids, read back."""
    schema, path = _files(spark, folder)
    relabel_files(spark, schema, path, f"{path}-dense")
    return read_edges(spark, f"{path}-dense/Customer_PLACED_Order.csv")


def _stored(spark: SparkSession, folder: str) -> GraphCatalog:
    schema, path = _files(spark, folder)
    store_graph(load_graph(spark, schema, path, relabel=True), f"{path}-stored")
    return open_graph(spark, f"{path}-stored")


def _stored_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of two nations, by target, and orders of three customers, from the stored graph."""
    g = _stored(spark, folder)
    found = g.edges_at("IN_NATION", "dst", [3, 7]).withColumn("label", F.lit("IN_NATION"))
    return _raw(found.unionByName(g.edges_at("PLACED", "src", [1, 4, 9]).withColumn("label", F.lit("PLACED"))), "src", "dst")


def _pattern_file(spark: SparkSession, folder: str) -> DataFrame:
    """The count that a pattern from a JSON file has on the stored graph."""
    pattern = Pattern.of("n:Nation; c:Customer; o:Order", "(c)-[IN_NATION]->(n); (c)-[PLACED]->(o)", "")
    path = f"{Scratch(spark).path}/pattern"
    spark.createDataFrame([(json.dumps(pattern.to_json()),)], "value string").coalesce(1).write.text(path)
    text = spark.read.text(path, wholetext=True).first().value
    return PatternEngine(_stored(spark, folder)).match_counts(Pattern.from_json(json.loads(text)), ["n"])


def _dangling(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose customer is not among the vertices, which are the customers of one segment."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    schema = GraphSchema({"Customer": "", "Order": ""}, {}, [EdgeTable("PLACED", "Customer", "Order")])
    vertices = {"Customer": read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")), "Order": read("orders").select(F.col("o_orderkey").alias("id"))}
    edges = {("PLACED", "Customer", "Order"): read("orders").select(F.col("o_custkey").cast("long").alias("src"), F.col("o_orderkey").cast("long").alias("dst"))}
    return _raw(catalog_from_tables(spark, schema, vertices, edges).dangling(), "src", "dst")


def _match_rows(spark: SparkSession, folder: str) -> DataFrame:
    return PatternEngine(graph(spark, folder)).match(Pattern.of(*PATTERNS["g2_cycle"]), ["c", "o", "s", "n"])


def _match_optional(spark: SparkSession, folder: str) -> DataFrame:
    return PatternEngine(graph(spark, folder)).match(Pattern.of(*PATTERNS["g7_optional"]), ["c", "o", "p"])


def _semi(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    placed, lines = g.edges("PLACED"), g.sources("CONTAINS")
    return _raw(placed.join(lines.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "src", "dst")


def _difference(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of each nation without any interest."""
    g = graph(spark, folder)
    idle = g.vertices("Customer").join(g.sources("HAS_INTEREST"), "id", "left_anti")
    return idle.join(g.edges("IN_NATION", ["Customer"]).select(F.col("src").alias("id"), "dst"), "id").groupBy(raw_id(F.col("dst")).alias("n")).agg(F.count(F.lit(1)).alias("customers"))


def _common(spark: SparkSession, folder: str) -> DataFrame:
    """Number of common neighbours of each pair that knows each other."""
    edges = graph(spark, folder).edges("KNOWS")
    pairs = edges.where("src < dst").select("src", "dst")
    end = lambda df, name: Relation(df, (name, "v") if name else ("src", "dst"), 1.0, {name: 1.0, "v": 1.0} if name else {"src": 1.0, "dst": 1.0})
    near = [end(edges.select(F.col("src").alias(n), F.col("dst").alias("v")), n) for n in ("src", "dst")]
    found = intersect_neighbours(end(pairs, ""), *near, "v").df.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("common"))
    return _raw(pairs.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0)).cast("long").alias("common")), "src", "dst")


_LABELS = ["Customer", "EventType", "Nation", "Order", "Part", "Region", "Supplier"]

GRAPH_QUERIES = {
    "s5_dense_ids": _renumbered,
    "s2_load_csv": _loaded,
    "s5_relabel_files": _relabelled,
    "s9_store_and_open": lambda s, d: _stored(s, d).summary(),
    "s11_lookup_stored": _stored_lookup,
    "s17_pattern_file": _pattern_file,
    "s13_vertices_of_super_label": lambda s, d: graph(s, d).vertices("Party").select(raw_id(F.col("id")).alias("id"), label_of(F.col("id"), _LABELS).alias("label")),
    "s15_edge_set": lambda s, d: _raw(graph(s, d).edges("CONTAINS"), "src", "dst"),
    "s16_summary": lambda s, d: graph(s, d).summary(),
    "a4_sources": lambda s, d: _raw(graph(s, d).sources("SUPPLIES"), "id"),
    "a5_out_degree": lambda s, d: _raw(graph(s, d).out_degrees("PLACED"), "src"),
    "a5_in_degree": lambda s, d: _raw(graph(s, d).in_degrees("SUPPLIED_BY"), "dst"),
    "a5_degree_undirected": lambda s, d: _raw(graph(s, d).out_degrees("KNOWS"), "src"),
    "a6_id_ranges": lambda s, d: graph(s, d).id_ranges(),
    "j9_semi_join": _semi,
    "j13_dangling": _dangling,
    "j14_adjacency": lambda s, d: graph(s, d).adjacency("CONTAINS").select(raw_id(F.col("id")).alias("id"), F.array_join(F.transform("neighbours", raw_id), ",").alias("neighbours")),
    "j15_reverse_adjacency": lambda s, d: graph(s, d).adjacency("IN_NATION", ["Supplier"], reverse=True).select(raw_id(F.col("id")).alias("id"), F.array_join(F.transform("neighbours", raw_id), ",").alias("neighbours")),
    "f2_common_neighbours": _common,
    "f3_difference": _difference,
    "match_cycle": _match_rows,
    "match_optional": _match_optional,
}

_EDGE_SQL = {
    ("CONTAINS", "Order", "Part"): f"SELECT o AS src, p AS dst FROM {_CONTAINS}",
    ("HAS_INTEREST", "Customer", "EventType"): "SELECT c AS src, t AS dst FROM interest",
    ("IN_NATION", "Customer", "Nation"): "SELECT c_custkey AS src, c_nationkey AS dst FROM customer",
    ("IN_NATION", "Supplier", "Nation"): "SELECT s_suppkey AS src, s_nationkey AS dst FROM supplier",
    ("IN_REGION", "Nation", "Region"): "SELECT n_nationkey AS src, n_regionkey AS dst FROM nation",
    ("KNOWS", "Customer", "Customer"): "SELECT a AS src, b AS dst FROM knows",
    ("PLACED", "Customer", "Order"): "SELECT o_custkey AS src, o_orderkey AS dst FROM orders",
    ("SUPPLIED_BY", "Order", "Supplier"): f"SELECT o AS src, s AS dst FROM {_SUPPLIED}",
    ("SUPPLIES", "Supplier", "Part"): f"SELECT s AS src, p AS dst FROM {_SUPPLIES}",
}
#: Dense ids of customers, orders and nations.
_DENSE = "WITH " + ", ".join(f"{x} AS (SELECT {k} AS id, row_number() OVER (ORDER BY {k}) - 1 AS d FROM {t})" for x, k, t in (("c", "c_custkey", "customer"), ("o", "o_orderkey", "orders"), ("n", "n_nationkey", "nation")))
_VERTEX_SQL = {"Customer": "customer", "EventType": "types", "Nation": "nation", "Order": "orders", "Part": "part", "Region": "region", "Supplier": "supplier"}

_KEY_SQL = {"Customer": "c_custkey", "EventType": "id", "Nation": "n_nationkey", "Order": "o_orderkey", "Part": "p_partkey", "Region": "r_regionkey", "Supplier": "s_suppkey"}

GRAPH_SQL = {
    "s5_dense_ids": _WITH
    + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS dense FROM ("
    + " UNION ".join(f"SELECT CAST({_KEY_SQL[x]} AS BIGINT) + {i} * 1099511627776 AS id FROM {_VERTEX_SQL[x]} WHERE {_KEY_SQL[x]} IS NOT NULL" for i, x in enumerate(_LABELS))
    + ")",
    "s13_vertices_of_super_label": f"SELECT id, kind AS label FROM {_PARTY}",
    "s15_edge_set": f"SELECT o AS src, p AS dst FROM {_CONTAINS}",
    "s16_summary": _WITH
    + " UNION ALL ".join(
        [f"SELECT 'vertex' AS kind, '{k}' AS label, CAST(NULL AS VARCHAR) AS src_label, CAST(NULL AS VARCHAR) AS dst_label, count(*) AS n FROM {t}" for k, t in _VERTEX_SQL.items()]
        + [f"SELECT 'edge', '{k[0]}', '{k[1]}', '{k[2]}', count(*) FROM ({q})" for k, q in _EDGE_SQL.items()]
    ),
    "a4_sources": "SELECT DISTINCT l_suppkey AS id FROM lineitem",
    "a5_out_degree": "SELECT o_custkey AS src, count(*) AS degree FROM orders GROUP BY 1",
    "a5_in_degree": "SELECT l_suppkey AS dst, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1",
    "a5_degree_undirected": _WITH + "SELECT a AS src, count(*) AS degree FROM knows GROUP BY 1",
    "a6_id_ranges": _WITH
    + " UNION ALL ".join(
        f"SELECT '{k[0]}' AS label, '{k[1]}' AS src_label, '{k[2]}' AS dst_label, CAST(min(src) AS BIGINT) AS min_src, CAST(max(src) AS BIGINT) AS max_src, CAST(min(dst) AS BIGINT) AS min_dst, CAST(max(dst) AS BIGINT) AS max_dst FROM ({q})"
        for k, q in _EDGE_SQL.items()
    ),
    "j9_semi_join": "SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "j13_dangling": "SELECT 'PLACED' AS label, o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "s2_load_csv": "SELECT 'PLACED' AS label, o_custkey AS src, o_orderkey * 7 + 3 AS dst FROM orders UNION ALL SELECT 'IN_NATION', c_custkey, c_nationkey FROM customer",
    "s5_relabel_files": f"{_DENSE} SELECT c.d AS src, o.d AS dst FROM orders JOIN c ON c.id = o_custkey JOIN o ON o.id = o_orderkey",
    "s9_store_and_open": "SELECT 'vertex' AS kind, 'Customer' AS label, CAST(NULL AS VARCHAR) AS src_label, CAST(NULL AS VARCHAR) AS dst_label, count(*) AS n FROM customer"
    " UNION ALL SELECT 'vertex', 'Nation', NULL, NULL, count(*) FROM nation UNION ALL SELECT 'vertex', 'Order', NULL, NULL, count(*) FROM orders"
    " UNION ALL SELECT 'edge', 'IN_NATION', 'Customer', 'Nation', count(*) FROM customer UNION ALL SELECT 'edge', 'PLACED', 'Customer', 'Order', count(*) FROM orders",
    "s11_lookup_stored": f"{_DENSE} SELECT 'IN_NATION' AS label, c.d AS src, n.d AS dst FROM customer JOIN c ON c.id = c_custkey JOIN n ON n.id = c_nationkey WHERE n.d IN (3, 7)"
    " UNION ALL SELECT 'PLACED', c.d, o.d FROM orders JOIN c ON c.id = o_custkey JOIN o ON o.id = o_orderkey WHERE c.d IN (1, 4, 9)",
    "s17_pattern_file": f"{_DENSE} SELECT n.d AS n, count(*) AS match_count FROM customer JOIN orders ON o_custkey = c_custkey JOIN n ON n.id = c_nationkey GROUP BY 1",
    "j14_adjacency": f"SELECT o AS id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS neighbours FROM {_CONTAINS} GROUP BY o",
    "j15_reverse_adjacency": "SELECT CAST(s_nationkey AS BIGINT) AS id, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS neighbours FROM supplier GROUP BY 1",
    "f2_common_neighbours": _WITH
    + "SELECT k.a AS src, k.b AS dst, (SELECT count(*) FROM knows x JOIN knows y ON x.b = y.b WHERE x.a = k.a AND y.a = k.b) AS common FROM knows k WHERE k.a < k.b",
    "f3_difference": _WITH + "SELECT CAST(c_nationkey AS BIGINT) AS n, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT c FROM interest) GROUP BY 1",
    "match_cycle": f"SELECT c_custkey AS c, o_orderkey AS o, l.s AS s, CAST(s_nationkey AS BIGINT) AS n FROM {_MATCHES['g2_cycle'][1]}",
    "match_optional": f"SELECT o_custkey AS c, o_orderkey AS o, l.p AS p FROM {_MATCHES['g7_optional'][1]}",
}


def queries() -> dict:
    def counted(name: str, strategy: str = "auto"):
        return lambda spark, folder: PatternEngine(graph(spark, folder)).count(Pattern.of(*PATTERNS[name]), strategy)

    def bound(name: str):
        pattern, names = BINDINGS[name]
        return lambda spark, folder: PatternEngine(graph(spark, folder)).match_counts(Pattern.of(*PATTERNS[pattern]), names)

    out = {n: counted(n) for n in PATTERNS}
    out |= {n: counted(p, s) for n, (p, s) in STRATEGIES.items()}
    return out | {n: bound(n) for n in BINDINGS} | GRAPH_QUERIES


def oracle_sql() -> dict[str, str]:
    out = {n: _count_sql(n) for n in PATTERNS}
    out |= {n: _count_sql(p) for n, (p, _) in STRATEGIES.items()}
    return out | {n: _binding_sql(n) for n in BINDINGS} | GRAPH_SQL
