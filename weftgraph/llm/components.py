"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours are joined to the smallest node known around u.

    The large star moves larger neighbours, the small star moves u and its smaller neighbours. The
    minima are grouped by u and one more column of theirs, so that the join deals them anew and
    adaptive execution can split the edges of a node that has very many.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u", F.lit(0).alias("_z")).agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own)
    return moved.where("u <> v").distinct()


def _contract(edges: DataFrame) -> DataFrame:
    """Links of each task replaced by stars: every node to the smallest that the task's own links
    lead to. No link between components is lost, and chains become short."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x: int) -> int:
            path = []
            while (up := parent.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                parent[y] = x
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        for i in range(0, len(nodes), 10_000):
            own = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links`; a component's name is its smallest node.

    Links are first contracted within each task; then large-star and small-star steps alternate over
    the table of links, in rounds that grow with the logarithm of the longest chain. Each round is
    written to the shared folder, and the one before it dropped. Links with a null end and links of
    a node with itself are left out; repeated links count once.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    scratch = Scratch(links.sparkSession)
    edges = scratch.save(_contract(edges), "links")
    last, state = "links", None
    for k in range(most_rounds):
        edges = scratch.save(_star(_star(edges, large=True), large=False), f"stars-{k}")
        scratch.drop(last)
        last = f"stars-{k}"
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
