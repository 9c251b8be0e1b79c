"""The engine: patterns over a catalog."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import label_of, raw_id
from weftgraph.plans.compiler import Compiler
from weftgraph.plans.pattern import Pattern
from weftgraph.sources.catalog import GraphCatalog


class PatternEngine:
    """Counts and lists matches of patterns; every pattern is validated first."""

    def __init__(self, catalog: GraphCatalog, strict_limits: bool = False):
        self.catalog, self.strict_limits = catalog, strict_limits

    def compile(self, pattern: Pattern | dict | str | Path) -> Compiler:
        if not isinstance(pattern, Pattern):
            pattern = Pattern.from_json(pattern)
        return Compiler(self.catalog, pattern.validate(self.catalog, self.strict_limits))

    def count(self, pattern, strategy: str = "auto") -> DataFrame:
        """One row: match_count (long). No match is 0."""
        return self.compile(pattern).count(strategy)

    def match(self, pattern, names: list[str] | None = None) -> DataFrame:
        """One row per match: the raw id of each vertex in `names` (all by default), and its leaf
        label in <name>_label where its label is a super-label."""
        c = self.compile(pattern)
        names = names or [v.name for v in c.pattern.vertices]
        return c.match(names).select(*self._decoded(c, names))

    def match_counts(self, pattern, names: list[str]) -> DataFrame:
        """match_count for each binding of `names`, decoded like match()."""
        c = self.compile(pattern)
        return c.grouped(names).select(*self._decoded(c, names), "match_count")

    def _decoded(self, c: Compiler, names: list[str]) -> list:
        out = []
        for i, n in enumerate(names):
            out.append(raw_id(F.col(f"m{i}")).alias(n))
            if c.pattern.label(n) in self.catalog.schema.supers:
                out.append(label_of(F.col(f"m{i}"), self.catalog.schema.ordered_leaves).alias(f"{n}_label"))
        return out

    def explain(self, pattern, strategy: str = "auto") -> str:
        """The pattern, the strategy taken and Spark's plan."""
        c = self.compile(pattern)
        chosen = c.choose() if strategy == "auto" else strategy
        df = c.count(strategy)
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"pattern: {c.pattern.to_json()}\nstrategy: {chosen}\n{plan}"

    def run(self, pattern, strategy: str = "auto") -> tuple[int, float]:
        """The count, and the seconds that reading and matching took."""
        df = self.count(pattern, strategy)
        began = time.time()
        return df.first()["match_count"], time.time() - began
