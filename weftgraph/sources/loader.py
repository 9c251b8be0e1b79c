"""Graphs from CSV or Parquet files, dense renumbering, and the stored form of a graph."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.ids import LARGEST_RAW, global_id, raw_id
from weftgraph.sources.catalog import EdgeStats, GraphCatalog
from weftgraph.sources.schema import GraphSchema
from weftgraph.sources.shared import save


def _path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _lines(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(value): the lines of a text file or folder, without each file's first one if it is a header.
    Empty lines are none."""
    plain = spark.read.option("header", header).option("sep", "\u0001").option("quote", "").option("escape", "").option("comment", "")
    return plain.schema("value string").csv(path).where("value is not null")


#: What a vertex line begins with, and an edge line; anything may follow.
_VERTEX = r"^\s*(\d+)(?![0-9A-Za-z])"
_EDGE = r"^[^0-9A-Za-z]*(\d+)[^0-9A-Za-z]+(\d+)(?![0-9A-Za-z])"


def _parsed(spark: SparkSession, path: str, header: bool, pattern: str, names: list[str]) -> DataFrame:
    """Lines with their numbers, null where a line does not have them or they are no ids."""
    lines = _lines(spark, path, header)
    numbers = [F.regexp_extract("value", pattern, i + 1).try_cast("long") for i in range(len(names))]
    return lines.select("value", *[F.when(x.between(0, LARGEST_RAW), x).alias(n) for n, x in zip(names, numbers, strict=True)])


def _checked(parsed: DataFrame, path: str, names: list[str], malformed: str) -> DataFrame:
    if malformed not in ("error", "skip"):
        raise ValueError(f"malformed: {malformed!r} is neither 'error' nor 'skip'")
    whole = F.lit(True)
    for n in names:
        whole &= F.col(n).isNotNull()
    if malformed == "skip":
        return parsed.where(whole).select(*names)
    bad = F.raise_error(F.concat(F.lit(f"malformed line in {path}: "), F.col("value"))).cast("long")
    return parsed.select(*[F.when(whole, F.col(n)).otherwise(bad).alias(n) for n in names])


def read_vertices(spark: SparkSession, path: str, header: bool = True, malformed: str = "error") -> DataFrame:
    """(id): the leading number of each line, whatever follows it. A line without one, or with a
    number that is no id, raises when it is read, or is left out with malformed="skip"; see
    malformed_lines(). With `header` the first line is not looked at. Parquet files give their
    first column."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(F.col(df.columns[0]).cast("long").alias("id"))
    return _checked(_parsed(spark, path, header, _VERTEX, ["id"]), path, ["id"], malformed)


def read_edges(spark: SparkSession, path: str, header: bool = True, malformed: str = "error") -> DataFrame:
    """(src, dst): the first two numbers of each line, with any blanks or signs between. Other lines
    are treated as by read_vertices()."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(F.col(df.columns[0]).cast("long").alias("src"), F.col(df.columns[1]).cast("long").alias("dst"))
    return _checked(_parsed(spark, path, header, _EDGE, ["src", "dst"]), path, ["src", "dst"], malformed)


def malformed_lines(spark: SparkSession, schema: GraphSchema, folder: str, header: bool = True) -> DataFrame:
    """(file, lines): how many lines of each CSV file malformed="skip" leaves out, where there are any."""
    out = spark.createDataFrame([], "file string, lines long")
    for names, pattern, files in ((["id"], _VERTEX, schema.leaves.values()), (["src", "dst"], _EDGE, [e.file for e in schema.edges])):
        for f in sorted({x for x in files if not x.endswith(".parquet")}):
            bad = _parsed(spark, _path(folder, f), header, pattern, names).where(" or ".join(f"{n} is null" for n in names))
            out = out.unionByName(bad.agg(F.count(F.lit(1)).alias("lines")).where("lines > 0").select(F.lit(f).alias("file"), "lines"))
    return out


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, dense): distinct values of `id` numbered from 0 in their order; of any type that sorts.

    Values are dealt by ranges and numbered within them as they lie, however sparse they are; a
    range starts where the ones before it end, by a running sum over the ranges, as many as tasks.
    The numbered ranges are written once, so that all uses see the same ones."""
    ranges = ids.select("id").where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    # The row's number within its task is in the lower 33 bits, the task's above.
    placed = save(ranges.withColumn("place", F.monotonically_increasing_id()), "dense-ids")
    task, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each task that wrote: few whatever the number of ids.
    return placed.withColumn("task", task).join(F.broadcast(bases), "task").select("id", (within + F.col("base")).alias("dense"))


def renumber(edges: DataFrame, src_ids: DataFrame, dst_ids: DataFrame, dangling: str = "error") -> DataFrame:
    """Edges with both ends replaced by dense ids; edges with an end that has none are an error,
    or dropped with dangling="drop"."""
    how = "inner" if dangling == "drop" else "left"
    s = src_ids.select(F.col("id").alias("src"), F.col("dense").alias("_s"))
    d = dst_ids.select(F.col("id").alias("dst"), F.col("dense").alias("_d"))
    out = edges.join(s, "src", how).join(d, "dst", how)
    if how == "left":
        found = lambda new, old: F.when(F.col(new).isNotNull(), F.col(new)).otherwise(F.raise_error(F.concat(F.lit("edge end without a vertex: "), F.col(old).cast("string"))).cast("long"))
        return out.select(found("_s", "src").alias("src"), found("_d", "dst").alias("dst"))
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def edge_set(edges: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """Each pair once, and self-loops kept unless told otherwise."""
    return (edges.where("src <> dst") if drop_self_loops else edges).distinct()


def _with_reverse(tables: dict[tuple[str, str, str], DataFrame], undirected: set[str], drop_self_loops: bool) -> dict[tuple[str, str, str], DataFrame]:
    """Edge tables as sets, with the reverse of undirected ones."""
    parts: dict[tuple[str, str, str], list[DataFrame]] = {}
    for (label, src, dst), t in tables.items():
        parts.setdefault((label, src, dst), []).append(t.select("src", "dst"))
        if label in undirected:
            parts.setdefault((label, dst, src), []).append(t.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = {}
    for k, ts in parts.items():
        union = ts[0]
        for t in ts[1:]:
            union = union.unionByName(t)
        out[k] = edge_set(union, drop_self_loops)
    return out


def catalog_from_tables(spark: SparkSession, schema: GraphSchema, vertices: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], drop_self_loops: bool = False, stats: dict[tuple[str, str, str], EdgeStats] | None = None) -> GraphCatalog:
    """A catalog over tables of raw ids: vertices (id) by leaf label, edges (src, dst) by (label,
    source leaf, target leaf)."""
    packed_v = {k: t.where("id is not null").select(global_id(schema.ordinal(k), F.col("id")).alias("id")).distinct() for k, t in vertices.items()}
    # Nulls are left out of raw columns, where the scan can do it.
    whole = {k: t.where("src is not null and dst is not null") for k, t in edges.items()}
    packed_e = {k: t.select(global_id(schema.ordinal(k[1]), F.col("src")).alias("src"), global_id(schema.ordinal(k[2]), F.col("dst")).alias("dst")) for k, t in whole.items()}
    return GraphCatalog(spark, schema, packed_v, _with_reverse(packed_e, schema.undirected, drop_self_loops), stats)


def load_graph(spark: SparkSession, schema: GraphSchema, folder: str, header: bool = True, relabel: bool = False, dangling: str = "error", drop_self_loops: bool = False, malformed: str = "error") -> GraphCatalog:
    """Read a graph's files. header: the first line of each is not looked at. relabel: number each
    leaf label's vertices densely from 0. malformed: "error" or "skip", see read_vertices().

    dangling says what an edge end without a vertex is: "error" and "drop" as named, and "keep"
    (without relabel) takes edges as they are, unchecked."""
    vertices = {k: read_vertices(spark, _path(folder, f), header, malformed) for k, f in schema.leaves.items()}
    edges: dict[tuple[str, str, str], DataFrame] = {}
    for e in schema.edges:
        t = read_edges(spark, _path(folder, e.file), header, malformed)
        edges[e.key] = edges[e.key].unionByName(t) if e.key in edges else t
    if relabel:
        maps = {k: dense_ids(t) for k, t in vertices.items()}
        vertices = {k: m.select(F.col("dense").alias("id")) for k, m in maps.items()}
        edges = {k: renumber(t, maps[k[1]], maps[k[2]], dangling) for k, t in edges.items()}
    elif dangling == "drop":
        edges = {k: t.join(vertices[k[1]].select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(vertices[k[2]].select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst") for k, t in edges.items()}
    elif dangling == "error":
        raw = {k: v.withColumn("dense", F.col("id")).distinct() for k, v in vertices.items()}
        edges = {k: renumber(t, raw[k[1]], raw[k[2]]) for k, t in edges.items()}
    return catalog_from_tables(spark, schema, vertices, edges, drop_self_loops)


def relabel_files(spark: SparkSession, schema: GraphSchema, source: str, target: str, header: bool = True, dangling: str = "error", overwrite: bool = False, malformed: str = "error") -> None:
    """Write the graph's CSV files again with dense ids, under the same names. Nothing is asked: a
    target that exists is an error unless `overwrite`."""
    mode = "overwrite" if overwrite else "errorifexists"
    maps = {k: dense_ids(read_vertices(spark, _path(source, f), header, malformed)) for k, f in schema.leaves.items()}
    for k, f in schema.leaves.items():
        maps[k].select(F.col("dense").alias(":ID")).write.csv(_path(target, f), sep="|", header=True, mode=mode)
    for e in schema.edges:
        out = renumber(read_edges(spark, _path(source, e.file), header, malformed), maps[e.src], maps[e.dst], dangling)
        out.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID")).write.csv(_path(target, e.file), sep="|", header=True, mode=mode)


def _edge_dir(key: tuple[str, str, str]) -> str:
    return str(PurePosixPath("edges", "__".join(key)))


def store_graph(catalog: GraphCatalog, folder: str, overwrite: bool = False, reverse: bool = True) -> None:
    """Write a graph as Parquet, with global ids, its schema and statistics. Edges are dealt and
    sorted by source, and stored by target too with `reverse`: a filter on ids at either end goes to
    the scan as it is, and the files' statistics say which row groups can have them."""
    spark, mode = catalog.spark, "overwrite" if overwrite else "errorifexists"
    stats = []
    for leaf in catalog.schema.ordered_leaves:
        catalog.vertices(leaf).sortWithinPartitions("id").write.parquet(_path(folder, f"vertices/{leaf}"), mode=mode)
    for key in sorted(catalog._edges):
        edges = catalog.edge_table(key).select("src", "dst")
        edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.parquet(_path(folder, _edge_dir(key)), mode=mode)
        stored = spark.read.schema("src long, dst long").parquet(_path(folder, _edge_dir(key)))
        if reverse:
            stored.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").write.parquet(_path(folder, _edge_dir(key) + ".by_target"), mode=mode)
        r = stored.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")).first()
        stats.append({"key": list(key), "rows": r.n, "sources": r.s, "targets": r.d, "by_target": reverse})
    spec = json.dumps({"schema": catalog.schema.to_json(), "edges": stats})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.mode(mode).text(_path(folder, "catalog"))


def open_graph(spark: SparkSession, folder: str) -> GraphCatalog:
    """A stored graph. Its edges are sets already, with both directions of undirected labels."""
    spec = json.loads("\n".join(r.value for r in spark.read.text(_path(folder, "catalog"), wholetext=True).collect()))
    schema = GraphSchema.from_json(spec["schema"])
    vertices = {x: spark.read.schema("id long").parquet(_path(folder, f"vertices/{x}")) for x in schema.ordered_leaves}
    edges, by_target, stats = {}, {}, {}
    for e in spec["edges"]:
        key = tuple(e["key"])
        edges[key] = spark.read.schema("src long, dst long").parquet(_path(folder, _edge_dir(key)))
        if e["by_target"]:
            by_target[key] = spark.read.schema("src long, dst long").parquet(_path(folder, _edge_dir(key) + ".by_target"))
        stats[key] = EdgeStats(e["rows"], e["sources"], e["targets"])
    return GraphCatalog(spark, schema, vertices, edges, stats, by_target)
