"""The graph as a set of DataFrames with the numbers that planning needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ids import LARGEST_RAW, RAW_BITS, raw_id
from weftgraph.sources.schema import GraphSchema, SchemaError


@dataclass(frozen=True)
class EdgeStats:
    """Rows of an edge table and distinct vertices at its ends; estimates will do."""

    rows: int
    sources: int
    targets: int


#: Neighbours in one list of an adjacency, about and at most.
LIST = 100_000


class GraphCatalog:
    """Vertex tables (id) and edge tables (src, dst) over global ids.

    Edge tables are sets: each pair once, with both directions of undirected labels. `stats` may be
    given; what is missing is counted once, when a plan first asks for it.
    """

    def __init__(self, spark: SparkSession, schema: GraphSchema, vertices: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], stats: dict[tuple[str, str, str], EdgeStats] | None = None, by_target: dict[tuple[str, str, str], DataFrame] | None = None):
        self.spark, self.schema, self._vertices, self._edges = spark, schema, vertices, edges
        #: Edge tables stored a second time in order of their targets, where there are such.
        self._by_target = by_target or {}
        self._stats = dict(stats or {})
        self._skew: dict[tuple[str, str, str], float] = {}
        self._labels = {k[0] for k in edges} | {e.label for e in schema.edges}

    # Lookup

    def leaves(self, label: str) -> list[str]:
        return self.schema.leaves_of(label)

    def has_vertex_label(self, label: str) -> bool:
        return label in self.schema.leaves or label in self.schema.supers

    def has_edge_label(self, label: str) -> bool:
        return label in self._labels

    def is_undirected(self, label: str) -> bool:
        return label in self.schema.undirected

    def edge_keys(self, label: str, src: list[str] | None = None, dst: list[str] | None = None) -> list[tuple[str, str, str]]:
        """Edge tables of a label whose ends are among these leaf labels; others are never read."""
        if not self.has_edge_label(label):
            raise SchemaError(f"unknown edge label {label!r}")
        return [k for k in self._edges if k[0] == label and (src is None or k[1] in src) and (dst is None or k[2] in dst)]

    def edge_table(self, key: tuple[str, str, str]) -> DataFrame:
        return self._edges[key]

    def edges(self, label: str, src: list[str] | None = None, dst: list[str] | None = None) -> DataFrame:
        """Bag union of the label's tables between these leaf labels."""
        return self._union([self._edges[k] for k in self.edge_keys(label, src, dst)], "src long, dst long")

    def edges_at(self, label: str, end: str, ids: list[int], src: list[str] | None = None, dst: list[str] | None = None) -> DataFrame:
        """Edges whose source or target (`end`, "src" or "dst") has one of these raw ids.

        The ids are put as global ones into a filter on the stored column, which the scan sees; at
        targets the copy in their order is read, if the graph has one."""
        if end not in ("src", "dst"):
            raise ValueError(f"end: {end!r} is neither 'src' nor 'dst'")
        if bad := [i for i in ids if not 0 <= i <= LARGEST_RAW]:
            raise ValueError(f"vertex ids out of range: {bad}")
        found = []
        for key in self.edge_keys(label, src, dst):
            table = self._by_target.get(key, self._edges[key]) if end == "dst" else self._edges[key]
            base = self.schema.ordinal(key[1] if end == "src" else key[2]) << RAW_BITS
            found.append(table.where(F.col(end).isin([base | i for i in ids])).select("src", "dst"))
        return self._union(found, "src long, dst long")

    def into(self, label: str, src: list[str] | None = None, dst: list[str] | None = None) -> DataFrame:
        """Like edges(), from tables in order of their targets where there are such: what is grouped
        by target comes together in one task before it is shuffled."""
        return self._union([self._by_target.get(k, self._edges[k]) for k in self.edge_keys(label, src, dst)], "src long, dst long")

    def vertices(self, label: str) -> DataFrame:
        return self._union([self._vertices[x] for x in self.leaves(label)], "id long")

    def _union(self, tables: list[DataFrame], schema: str) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], schema)
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def stats(self, key: tuple[str, str, str]) -> EdgeStats:
        if key not in self._stats:
            r = self._edges[key].agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")).first()
            self._stats[key] = EdgeStats(r.n, r.s, r.d)
        return self._stats[key]

    def skew(self, key: tuple[str, str, str]) -> float:
        """How many times as many pairs of edges meet at a source or a target as would if all had
        the same degree; counted when it is first asked for."""
        if key not in self._skew:
            worst = 1.0
            for end in ("src", "dst"):
                d = self._edges[key].groupBy(end).agg(F.count(F.lit(1)).cast("double").alias("d"))
                r = d.agg(F.sum(F.col("d") * F.col("d")).alias("pairs"), F.sum("d").alias("rows"), F.count(F.lit(1)).alias("n")).first()
                if r.n:
                    worst = max(worst, r.pairs * r.n / (r.rows * r.rows))
            self._skew[key] = worst
        return self._skew[key]

    # Whole-graph views

    def out_degrees(self, label: str, src: list[str] | None = None, dst: list[str] | None = None) -> DataFrame:
        return self.edges(label, src, dst).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))

    def in_degrees(self, label: str, src: list[str] | None = None, dst: list[str] | None = None) -> DataFrame:
        return self.into(label, src, dst).groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))

    def sources(self, label: str) -> DataFrame:
        """Distinct vertices with an outgoing edge of the label."""
        return self.edges(label).select(F.col("src").alias("id")).distinct()

    def adjacency(self, label: str, src: list[str] | None = None, dst: list[str] | None = None, reverse: bool = False, most: int = LIST) -> DataFrame:
        """(id, block, neighbours): sorted distinct neighbours of each vertex, in lists of about
        `most` at most. A vertex of more has several blocks, numbered from 0: a neighbour's block
        follows from its id and the vertex's degree, so equal neighbours of two vertices of like
        degree are in blocks of one number."""
        e = self.into(label, src, dst) if reverse else self.edges(label, src, dst)
        a, b = ("dst", "src") if reverse else ("src", "dst")
        e = e.select(F.col(a).alias("id"), F.col(b).alias("n"))
        hubs = e.groupBy("id").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > most)
        hubs = hubs.select("id", F.expr(f"cast(pow(2, ceil(log2(d / {most}))) as int)").alias("blocks"))
        block = F.coalesce(F.pmod(F.xxhash64("n"), F.col("blocks")), F.lit(0)).cast("int")
        return e.join(hubs, "id", "left").groupBy("id", block.alias("block")).agg(F.sort_array(F.collect_set("n")).alias("neighbours"))

    def summary(self) -> DataFrame:
        """(kind, label, src_label, dst_label, n) of every vertex and edge table."""
        rows = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), F.lit(k).alias("label"), F.lit(None).cast("string").alias("src_label"), F.lit(None).cast("string").alias("dst_label"), "n") for k, t in sorted(self._vertices.items())]
        rows += [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.lit(k[0]).alias("label"), F.lit(k[1]).alias("src_label"), F.lit(k[2]).alias("dst_label"), "n") for k, t in sorted(self._edges.items())]
        return self._union(rows, "kind string, label string, src_label string, dst_label string, n long")

    def id_ranges(self) -> DataFrame:
        """(label, src_label, dst_label, min/max raw ids at both ends) of every edge table."""
        rows = [
            t.agg(*[f(raw_id(F.col(c))).alias(f"{n}_{c}") for c in ("src", "dst") for n, f in (("min", F.min), ("max", F.max))]).select(
                F.lit(k[0]).alias("label"), F.lit(k[1]).alias("src_label"), F.lit(k[2]).alias("dst_label"), "min_src", "max_src", "min_dst", "max_dst"
            )
            for k, t in sorted(self._edges.items())
        ]
        return self._union(rows, "label string, src_label string, dst_label string, min_src long, max_src long, min_dst long, max_dst long")

    def dangling(self) -> DataFrame:
        """(label, src, dst) of edges with an end that no vertex table has."""
        rows = []
        for (label, src, dst), t in sorted(self._edges.items()):
            known_src, known_dst = self._vertices[src].select(F.col("id").alias("src")), self._vertices[dst].select(F.col("id").alias("dst"))
            rows.append(t.join(known_src, "src", "left_anti").select(F.lit(label).alias("label"), "src", "dst"))
            rows.append(t.join(known_src, "src", "left_semi").join(known_dst, "dst", "left_anti").select(F.lit(label).alias("label"), "src", "dst"))
        return self._union(rows, "label string, src long, dst long")

    def persist(self, labels: list[str] | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, eager: bool = False) -> GraphCatalog:
        """Keep edge tables in memory, on disk where memory ends; eager: read them now."""
        for k, t in self._edges.items():
            if labels is None or k[0] in labels:
                t.persist(level)
                if eager:
                    t.count()
        return self

    def unpersist(self) -> GraphCatalog:
        for t in self._edges.values():
            t.unpersist()
        return self
