"""From patterns to DataFrames.

Every variable is a column named by its place (v0, v1, ...), as names of a pattern may differ in
case only. The planner fixes the order of joins and what is counted early; which kind of join and
how many partitions is left to Spark.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.relation import WEIGHT, Relation, differ, intersect_neighbours, join, project, with_edge, without_edge
from weftgraph.plans.pattern import NOT, REGULAR, Differ, Pattern, PatternEdge
from weftgraph.sources.catalog import GraphCatalog

#: Ways to count. "join" enumerates all matches; "declared" does so in the order in which edges are
#: written; "eager" adds up what is not needed any more as soon as possible; "subtract" also counts
#: constraints and NOT edges by inclusion and exclusion; "intersect" closes triangles from the end
#: with fewer neighbours, row by row; "reduce" first drops what has no partner in a neighbouring edge; "auto" chooses.
STRATEGIES = ("auto", "join", "declared", "eager", "subtract", "intersect", "reduce")
#: Constraints that "auto" counts by subtraction at most: each doubles the terms.
MOST_SUBTRACTED = 2
#: Rows of a join, by estimate, from which subtraction is worth its terms, and intersection the
#: degrees it counts first; fewer rows flow through faster.
LARGE = 1e8
#: Edges that meet at hubs this many times as often as at equal degrees are worth looking up from
#: the end with fewer neighbours; at equal degrees that end has as many, and the work is for nothing.
SKEWED = 4.0
#: Rows added up early must be expected to become fewer by this factor.
SHRINK = 2.0


class Compiler:
    def __init__(self, catalog: GraphCatalog, pattern: Pattern):
        self.catalog, self.pattern = catalog, pattern
        self.column = {v.name: f"v{i}" for i, v in enumerate(pattern.vertices)}
        self.leaves = {v.name: catalog.leaves(v.label) for v in pattern.vertices}
        #: Rows of the largest join planned so far, by estimate, and whether a triangle was closed.
        self.peak, self.closed = 0.0, False

    # Edges as relations

    def edge(self, e: PatternEdge, rename: dict[str, str] | None = None) -> Relation:
        """The edge's pairs. Endpoint labels choose the tables; an undirected edge is the bag of
        both directions, unless its label is undirected and stored both ways."""
        to = lambda n: self.column[(rename or {}).get(n, n)]
        tables, rows, ns, nd = [], 0.0, 0.0, 0.0
        ways = [(e.src, e.dst, False)]
        if e.undirected and not self.catalog.is_undirected(e.label):
            ways.append((e.dst, e.src, True))
        for a, b, swapped in ways:
            for key in self.catalog.edge_keys(e.label, self.leaves[a], self.leaves[b]):
                t, s = self.catalog.edge_table(key), self.catalog.stats(key)
                src, dst = ("dst", "src") if swapped else ("src", "dst")
                tables.append(t.select(F.col(src).alias("s"), F.col(dst).alias("d")))
                rows += s.rows
                ns += s.targets if swapped else s.sources
                nd += s.sources if swapped else s.targets
        df = reduce(DataFrame.unionByName, tables) if tables else self.catalog.spark.createDataFrame([], "s long, d long")
        a, b = to(e.src), to(e.dst)
        if a == b:
            return Relation(df.where("s = d").select(F.col("s").alias(a)), (a,), rows / max(ns, 1.0), {a: min(ns, nd)})
        # The pairs of an undirected label are the same from either end.
        same = frozenset((a, b)) if self.catalog.is_undirected(e.label) and self.leaves[e.src] == self.leaves[e.dst] else (a, b)
        known = (e.label, same, *(tuple(self.leaves[n]) for n in (e.src, e.dst))) if len(ways) == 1 else None
        return Relation(df.select(F.col("s").alias(a), F.col("d").alias(b)), (a, b), rows, {a: ns, b: nd}, edge=known)

    # The core: regular edges, constraints and NOT edges

    def core(self, keep: list[str], differs: list[Differ], nots: list[PatternEdge], extra: list[PatternEdge] = (), same: list[Differ] = (), eager: bool = True, ordered: bool = False, intersect: bool = False, semi: bool = False) -> Relation:
        """Matches of the regular edges and `extra` ones, with variables in `same` made one.

        keep: names of variables that must stay columns."""
        rename: dict[str, str] = {}

        def root(n: str) -> str:
            while n in rename:
                n = rename[n]
            return n

        for c in same:
            a, b = root(c.a), root(c.b)
            if a != b:
                rename[max(a, b)] = min(a, b)
        final = {n: root(n) for n in self.column}
        if any(final[c.a] == final[c.b] for c in differs):
            return self._none(keep)
        todo = [(Differ(final[c.a], final[c.b])) for c in differs]
        absent = [(e, self.edge(e, final)) for e in nots]
        parts = []
        for e in [*self.pattern.of_kind(REGULAR), *extra]:
            r = self.edge(e, final)
            # A set of pairs asked for twice holds each once.
            if r.edge is None or all(p.edge != r.edge for p in parts):
                parts.append(r)
        keep_columns = {self.column[final[n]] for n in keep}

        def settle(r: Relation) -> Relation:
            for c in list(todo):
                a, b = self.column[c.a], self.column[c.b]
                if a in r.vars and b in r.vars:
                    r = differ(r, a, b)
                    todo.remove(c)
            for item in list(absent):
                if set(item[1].vars) <= set(r.vars):
                    r = without_edge(r, item[1])
                    absent.remove(item)
            return r

        def needed(skip: list[int]) -> set[str]:
            out = set(keep_columns)
            for c in todo:
                out |= {self.column[c.a], self.column[c.b]}
            for _, n in absent:
                out |= set(n.vars)
            for i, p in enumerate(parts):
                if i not in skip:
                    out |= set(p.vars)
            return out

        parts = [settle(p) for p in parts]
        if semi:
            # Each part in turn by those before it, already reduced, and by those after it.
            for i in range(len(parts)):
                for j in range(len(parts)):
                    if i != j and set(parts[i].vars) & set(parts[j].vars):
                        parts[i] = with_edge(parts[i], parts[j])
        while True:
            # What no other part, constraint or result needs is added up, or just dropped.
            if eager:
                for i, p in enumerate(parts):
                    stay = [v for v in p.vars if v in needed([i])]
                    if len(stay) < len(p.vars) and (len(parts) > 1 or stay):
                        parts[i] = project(p, stay, not stay or p.groups(stay) * SHRINK <= p.rows or len(stay) == 1)
            if len(parts) == 1:
                break
            if intersect and (found := self._triangle(parts, needed)):
                i, j, k, v = found
                made = settle(intersect_neighbours(parts[i], parts[j], parts[k], v))
                self.closed = True
                parts = [p for n, p in enumerate(parts) if n not in (i, j, k)] + [made]
                continue
            i, j = self._next(parts, ordered)
            made = settle(join(parts[i], parts[j]))
            self.peak = max(self.peak, made.rows)
            parts = [made] + [p for n, p in enumerate(parts) if n not in (i, j)] if ordered else [p for n, p in enumerate(parts) if n not in (i, j)] + [made]
        out = parts[0]
        for n in keep:
            if self.column[n] not in out.vars:
                own, src = self.column[n], self.column[final[n]]
                out = Relation(out.df.withColumn(own, F.col(src)), (*out.vars, own), out.rows, out.distinct | {own: out.distinct[src]}, out.weighted)
        return out

    def _none(self, keep: list[str]) -> Relation:
        own = [self.column[n] for n in keep]
        df = self.catalog.spark.createDataFrame([], ", ".join(f"{c} long" for c in [*own, WEIGHT]))
        return Relation(df, tuple(own), 0.0, dict.fromkeys(own, 0.0), True)

    @staticmethod
    def _next(parts: list[Relation], ordered: bool) -> tuple[int, int]:
        """The two parts to join: those with the smallest result among those that share a variable.
        Ordered: the first with the first that touches it."""
        pairs = [(0, j) for j in range(1, len(parts))] if ordered else list(combinations(range(len(parts)), 2))
        touching = [(i, j) for i, j in pairs if set(parts[i].vars) & set(parts[j].vars)]
        if ordered:
            return (touching or pairs)[0]
        if not touching:
            return min(pairs, key=lambda p: parts[p[0]].rows * parts[p[1]].rows)
        # Of joins with results of like size, that which leaves fewer rows than it has read.
        return min(touching, key=lambda p: (parts[p[0]].estimate(parts[p[1]]) - parts[p[0]].rows - parts[p[1]].rows, p))

    @staticmethod
    def _triangle(parts: list[Relation], needed) -> tuple[int, int, int, str] | None:
        """(third, one, other, variable): two parts with a variable that is in no other part, and a
        third part that has all their others, so that the three close a cycle."""
        for j, k in combinations(range(len(parts)), 2):
            a, b = parts[j], parts[k]
            for v in sorted(set(a.vars) & set(b.vars)):
                if len(a.vars) < 2 or len(b.vars) < 2 or any(v in p.vars for i, p in enumerate(parts) if i not in (j, k)):
                    continue
                ends = (set(a.vars) | set(b.vars)) - {v}
                for i, p in enumerate(parts):
                    if i not in (j, k) and ends <= set(p.vars) and not set(a.vars) <= {*b.vars} and not set(b.vars) <= {*a.vars}:
                        return i, j, k, v
        return None

    # OPTIONAL

    def optional(self, r: Relation, later: set[str], count_only: bool) -> Relation:
        """Left joins, one for each vertex that optional edges bring in.

        A vertex's edges and the constraints on it and on vertices bound before are one condition;
        if no value meets it the vertex is null once. A null takes part in no edge and differs
        from everything. count_only: a vertex that nothing later needs is counted, not bound."""
        groups = self.pattern.optional_groups()
        bound = set(self.pattern.regular_names())
        for g, (name, edges) in enumerate(groups):
            own = self.column[name]
            differs = [c for c in self.pattern.constraints if name in (c.a, c.b) and ({c.a, c.b} - {name}) <= bound]
            used_later = name in later or any(name in e.ends() for _, es in groups[g + 1 :] for e in es) or any(name in (c.a, c.b) and not {c.a, c.b} <= bound | {name} for c in self.pattern.constraints)
            bound.add(name)
            parts = [self.edge(e) for e in edges]
            keys = sorted({v for p in parts for v in p.vars if v != own})
            others = [self.column[next(n for n in (c.a, c.b) if n != name)] for c in differs]
            null_keys = [v for v in others if v not in keys]
            if len(parts) == 1 and not null_keys:
                found = parts[0].df
            else:
                found = r.df.select(*keys, *[v for v in null_keys]).distinct()
                for p in parts:
                    found = found.join(p.df, [v for v in p.vars if v in found.columns])
            for v in others:
                found = found.where(~F.col(own).eqNullSafe(F.col(v)))
            if count_only and not used_later:
                total = found.groupBy(*keys, *null_keys).agg(F.count(F.lit(1)).alias("_n"))
                df = self._left(r.df, total, keys, null_keys)
                df = df.withColumn(WEIGHT, r.weight() * F.coalesce("_n", F.lit(1).cast("long"))).drop("_n")
                r = Relation(df.select(*r.vars, WEIGHT), r.vars, r.rows, r.distinct, True)
            else:
                df = self._left(r.df, found, keys, null_keys)
                r = Relation(df.select(*r.vars, own, *([WEIGHT] if r.weighted else [])), (*r.vars, own), r.rows, r.distinct | {own: 1.0}, r.weighted)
        return r

    @staticmethod
    def _left(df: DataFrame, found: DataFrame, keys: list[str], null_keys: list[str]) -> DataFrame:
        """Left join on keys, and on null_keys with nulls equal."""
        if not null_keys:
            return df.join(found, keys, "left")
        other = found.select(*[F.col(c).alias(f"_r_{c}") if c in keys or c in null_keys else F.col(c) for c in found.columns])
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in null_keys])
        return df.join(other, on, "left").drop(*[f"_r_{k}" for k in [*keys, *null_keys]])

    # Whole patterns

    def _split(self) -> tuple[list[Differ], list[str]]:
        """Constraints on regular vertices, and the regular vertices that optional parts need."""
        regular = self.pattern.regular_names()
        core = [c for c in self.pattern.constraints if {c.a, c.b} <= regular]
        later = {n for _, es in self.pattern.optional_groups() for e in es for n in e.ends() if n in regular}
        later |= {n for c in self.pattern.constraints if c not in core for n in (c.a, c.b) if n in regular}
        return core, [v.name for v in self.pattern.vertices if v.name in later]

    def choose(self) -> str:
        """What "auto" stands for. Where the largest join of early counting is large by estimate:
        subtraction, if inequalities, or NOT edges over edges with hubs, are what keeps an acyclic
        pattern from being added up before it, and intersection, if triangles of edges with hubs are
        closed. Early counting otherwise."""
        core, keep = self._split()
        nots = self.pattern.of_kind(NOT)
        self.peak, self.closed = 0.0, False
        self.core(keep, core, nots)
        if self.peak < LARGE:
            return "eager"
        if 0 < len(core) + len(nots) <= MOST_SUBTRACTED and not keep and self.pattern.is_acyclic() and (not nots or self._skewed()):
            return "subtract"
        self.core(keep, core, nots, intersect=True)
        return "intersect" if self.closed and self._skewed() else "eager"

    def _skewed(self) -> bool:
        """Whether an edge of the pattern has hubs. Asked only where a join is large: it takes a job."""
        edges = [*self.pattern.of_kind(REGULAR), *self.pattern.of_kind(NOT)]
        return any(self.catalog.skew(k) >= SKEWED for e in edges for k in self.catalog.edge_keys(e.label, self.leaves[e.src], self.leaves[e.dst]))

    def count(self, strategy: str = "auto") -> DataFrame:
        """One row, match_count."""
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}: {STRATEGIES}")
        strategy = self.choose() if strategy == "auto" else strategy
        core, keep = self._split()
        nots = self.pattern.of_kind(NOT)
        if strategy == "subtract":
            return self._subtract(core, nots, keep)
        options = {"eager": strategy in ("eager", "intersect"), "ordered": strategy == "declared", "intersect": strategy == "intersect", "semi": strategy == "reduce"}
        r = self.optional(self.core(keep, core, nots, **options), set(), options["eager"])
        return _total([(1, r)])

    def _subtract(self, core: list[Differ], nots: list[PatternEdge], keep: list[str]) -> DataFrame:
        """Sum over subsets of the constraints and NOT edges: those in the subset are turned into
        equalities and regular edges, and count negatively if they are odd in number. Triangles that
        NOT edges so close are intersected."""
        terms = []
        ties = [*core, *nots]
        for k in range(len(ties) + 1):
            for own in combinations(ties, k):
                same = [c for c in own if isinstance(c, Differ)]
                extra = [PatternEdge(e.src, e.dst, e.label) for e in own if isinstance(e, PatternEdge)]
                terms.append(((-1) ** k, self.optional(self.core(keep, [], [], extra, same, intersect=True), set(), True)))
        return _total(terms)

    def match(self, names: list[str] | None = None) -> DataFrame:
        """All matches, one row each: a column of global ids for each of `names`, null where an
        optional vertex is not there."""
        names = names or [v.name for v in self.pattern.vertices]
        core, keep = self._split()
        regular = self.pattern.regular_names()
        wanted = list(dict.fromkeys([*keep, *[n for n in names if n in regular]]))
        r = self.optional(self.core(wanted, core, self.pattern.of_kind(NOT), eager=False), set(names), False)
        return r.df.select(*[F.col(self.column[n]).alias(f"m{i}") for i, n in enumerate(names)])

    def grouped(self, names: list[str]) -> DataFrame:
        """Matches counted by bindings of `names`: columns m0, m1, ... and match_count. Variables
        that are not asked for are added up early."""
        core, keep = self._split()
        regular = self.pattern.regular_names()
        wanted = list(dict.fromkeys([*keep, *[n for n in names if n in regular]]))
        r = self.optional(self.core(wanted, core, self.pattern.of_kind(NOT)), set(names), True)
        keys = [F.col(self.column[n]).alias(f"m{i}") for i, n in enumerate(names)]
        return r.df.groupBy(*keys).agg((F.sum(WEIGHT) if r.weighted else F.count(F.lit(1))).alias("match_count"))


def _total(terms: list[tuple[int, Relation]]) -> DataFrame:
    """The signed sum of all matches, as one row."""
    rows = [r.df.agg((F.sum(WEIGHT) if r.weighted else F.count(F.lit(1))).alias("n")).select((F.coalesce("n", F.lit(0)) * F.lit(sign)).cast("long").alias("n")) for sign, r in terms]
    return reduce(DataFrame.unionByName, rows).agg(F.sum("n").cast("long").alias("match_count"))


__all__ = ["STRATEGIES", "Compiler"]
