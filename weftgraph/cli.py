"""Command line: build, relabel, query and summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weftgraph.engine import PatternEngine
from weftgraph.plans.compiler import STRATEGIES
from weftgraph.sources.loader import load_graph, malformed_lines, open_graph, relabel_files, store_graph
from weftgraph.sources.schema import GraphSchema


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("build", "store a graph from CSV files"), ("relabel", "write CSV files with dense ids")):
        p = sub.add_parser(name, help=text)
        p.add_argument("schema")
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--no-header", action="store_true")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--dangling", choices=["error", "drop"], default="error")
        p.add_argument("--malformed", choices=["error", "skip"], default="error", help="lines without ids: stop, or leave out and say how many")
        if name == "build":
            p.add_argument("--relabel", action="store_true")
            p.add_argument("--drop-self-loops", action="store_true")
    p = sub.add_parser("query", help="count a pattern's matches")
    p.add_argument("graph")
    p.add_argument("pattern")
    p.add_argument("--strategy", choices=STRATEGIES, default="auto")
    p.add_argument("--cache", action="store_true", help="keep edges in memory before the query")
    p.add_argument("--strict-limits", action="store_true")
    p.add_argument("--explain", action="store_true")
    p = sub.add_parser("summary", help="sizes of a stored graph's tables")
    p.add_argument("graph")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    if a.command == "build":
        g = load_graph(spark, GraphSchema.from_json(a.schema), a.source, not a.no_header, a.relabel, a.dangling, a.drop_self_loops, a.malformed)
        store_graph(g, a.target, a.overwrite)
    elif a.command == "relabel":
        relabel_files(spark, GraphSchema.from_json(a.schema), a.source, a.target, not a.no_header, a.dangling, a.overwrite, a.malformed)
    if a.command in ("build", "relabel") and a.malformed == "skip":
        for r in malformed_lines(spark, GraphSchema.from_json(a.schema), a.source, not a.no_header).collect():
            print(f"{r.file}: {r.lines} malformed lines left out")
    if a.command in ("build", "relabel"):
        return 0
    if a.command == "summary":
        open_graph(spark, a.graph).summary().show(1000, truncate=False)
    else:
        g = open_graph(spark, a.graph)
        if a.cache:
            g.persist(eager=True)
        engine = PatternEngine(g, a.strict_limits)
        if a.explain:
            print(engine.explain(a.pattern, a.strategy))
        n, seconds = engine.run(a.pattern, a.strategy)
        print(f"matches: {n}")
        print(f"seconds: {seconds:.3f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
