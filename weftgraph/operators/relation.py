"""Relations over pattern variables, with the sizes that ordering needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column of a relation that holds how many matches each row stands for.
WEIGHT = "w"


@dataclass
class Relation:
    """Rows bind `vars`, one column each. With `weighted` a row stands for `w` matches, else for
    one. `rows` and `distinct` (by variable) are estimates."""

    df: DataFrame
    vars: tuple[str, ...]
    rows: float
    distinct: dict[str, float]
    weighted: bool = False
    #: For an edge table that has no pair twice: what tells it from others.
    edge: tuple | None = None

    def weight(self):
        return F.col(WEIGHT) if self.weighted else F.lit(1).cast("long")

    def estimate(self, other: Relation) -> float:
        """Rows of the join with another relation on all shared variables."""
        out = self.rows * other.rows
        for v in set(self.vars) & set(other.vars):
            out /= max(1.0, self.distinct[v], other.distinct[v])
        return out

    def groups(self, keep: list[str]) -> float:
        """How many different bindings of `keep` there are, at most and by estimate."""
        out = 1.0
        for v in keep:
            out *= max(1.0, self.distinct[v])
        return min(out, self.rows)


def join(a: Relation, b: Relation) -> Relation:
    """Inner join on every shared variable at once, or a cross product if there is none."""
    shared = [v for v in a.vars if v in b.vars]
    out_vars = a.vars + tuple(v for v in b.vars if v not in a.vars)
    rows = a.estimate(b)
    x, y = a.df, b.df
    weighted = a.weighted or b.weighted
    if a.weighted and b.weighted:
        y = y.withColumnRenamed(WEIGHT, "_w")
    df = x.join(y, shared) if shared else x.crossJoin(y)
    if a.weighted and b.weighted:
        df = df.withColumn(WEIGHT, F.col(WEIGHT) * F.col("_w"))
    distinct = {v: min(rows or 1.0, a.distinct.get(v, float("inf")), b.distinct.get(v, float("inf"))) for v in out_vars}
    return Relation(df.select(*out_vars, *([WEIGHT] if weighted else [])), out_vars, rows, distinct, weighted)


def project(r: Relation, keep: list[str], aggregate: bool) -> Relation:
    """Only the variables in `keep`, as a bag: rows that become equal are added up to one, or left
    side by side."""
    keep = [v for v in r.vars if v in keep]
    if not aggregate:
        return Relation(r.df.select(*keep, *([WEIGHT] if r.weighted else [])), tuple(keep), r.rows, {v: r.distinct[v] for v in keep}, r.weighted)
    total = F.sum(WEIGHT) if r.weighted else F.count(F.lit(1))
    rows = r.groups(keep)
    return Relation(r.df.groupBy(*keep).agg(total.alias(WEIGHT)), tuple(keep), rows, {v: min(r.distinct[v], rows) for v in keep}, True)


def differ(r: Relation, a: str, b: str) -> Relation:
    return Relation(r.df.where(F.col(a) != F.col(b)), r.vars, r.rows, r.distinct, r.weighted)


def without_edge(r: Relation, edge: Relation) -> Relation:
    """Rows for which `edge` has no row with the same variables."""
    return Relation(r.df.join(edge.df, list(edge.vars), "left_anti"), r.vars, r.rows, r.distinct, r.weighted)


def with_edge(r: Relation, edge: Relation) -> Relation:
    """Rows for which `edge` has a row with the same shared variables, none of them twice."""
    shared = [v for v in r.vars if v in edge.vars]
    return Relation(r.df.join(edge.df, shared, "left_semi"), r.vars, r.rows, r.distinct, r.weighted)


def intersect_neighbours(pairs: Relation, a: Relation, b: Relation, v: str) -> Relation:
    """The join of `pairs`, a and b, where a and b share the variable v, which is not in `pairs`, and
    all their others are: pairs meet a and b at v.

    Each row of `pairs` is continued by that of a and b in which it has fewer partners, and then
    looked up in the other one by all its variables. So the rows made on the way are the sum of the
    lesser degrees, which for the triangles of m edges is below m ** 1.5 even with hubs, while one
    order for all rows makes the sum of squared degrees. Lists of neighbours are never gathered."""
    ka, kb = [u for u in a.vars if u != v], [u for u in b.vars if u != v]
    degrees = lambda r, keys, name: r.df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    plain = lambda r, name: r.df.withColumnRenamed(WEIGHT, name) if r.weighted else r.df
    df = plain(pairs, "_p").join(degrees(a, ka, "_da"), ka).join(degrees(b, kb, "_db"), kb)
    x, y = plain(a, "_a"), plain(b, "_b")
    by_a = df.where("_da <= _db").join(x, ka).join(y, [*kb, v])
    by_b = df.where("_da > _db").join(y, kb).join(x, [*ka, v])
    weights = [F.col(n) for r, n in ((pairs, "_p"), (a, "_a"), (b, "_b")) if r.weighted]
    out_vars = (*pairs.vars, v)
    out = by_a.unionByName(by_b)
    if weights:
        w = weights[0]
        for other in weights[1:]:
            w = w * other
        out = out.withColumn(WEIGHT, w)
    rows = pairs.estimate(a) * b.rows / max(1.0, a.distinct[v], b.distinct[v])
    for u in kb:
        rows /= max(1.0, pairs.distinct[u], b.distinct[u])
    distinct = pairs.distinct | {v: min(a.distinct[v], b.distinct[v])}
    return Relation(out.select(*out_vars, *([WEIGHT] if weights else [])), out_vars, rows, distinct, bool(weights))
