"""Graph schemas: leaf labels, super-labels, edge labels with their endpoint labels."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path


class SchemaError(ValueError):
    pass


_EDGE_FILE = re.compile(r"(?P<src>[^_./\\]+)_(?P<edge>[^/\\]+)_(?P<dst>[^_./\\]+)\.(csv|parquet)")


@dataclass(frozen=True)
class EdgeTable:
    """One edge file: its label and the leaf labels at its ends."""

    label: str
    src: str
    dst: str
    file: str = ""

    @property
    def key(self) -> tuple[str, str, str]:
        return (self.label, self.src, self.dst)


@dataclass
class GraphSchema:
    #: Leaf label to its file.
    leaves: dict[str, str]
    #: Super-label to its leaf labels, one level deep.
    supers: dict[str, list[str]] = field(default_factory=dict)
    edges: list[EdgeTable] = field(default_factory=list)
    undirected: set[str] = field(default_factory=set)

    def __post_init__(self):
        for name, own in self.supers.items():
            if name in self.leaves:
                raise SchemaError(f"{name!r} is both a leaf label and a super-label")
            if missing := [x for x in own if x not in self.leaves]:
                raise SchemaError(f"super-label {name!r} has unknown leaf labels {missing}")
        for e in self.edges:
            for end in (e.src, e.dst):
                if end not in self.leaves:
                    raise SchemaError(f"edge label {e.label!r} has an unknown endpoint label {end!r}")
        if unknown := self.undirected - {e.label for e in self.edges}:
            raise SchemaError(f"undirected edge labels without a file: {sorted(unknown)}")

    @property
    def ordered_leaves(self) -> list[str]:
        """Leaf labels by name; the place is the ordinal in global ids."""
        return sorted(self.leaves)

    def ordinal(self, leaf: str) -> int:
        return self.ordered_leaves.index(leaf)

    def leaves_of(self, label: str) -> list[str]:
        """Leaf labels of a leaf or super-label."""
        if label in self.leaves:
            return [label]
        if label in self.supers:
            return list(self.supers[label])
        raise SchemaError(f"unknown vertex label {label!r}")

    @classmethod
    def from_json(cls, source: str | Path | dict) -> GraphSchema:
        """Keys `vertices` (label to file, or super-label to such an object), `edges` (label to a
        file or a list of files named Src_label_Dst.csv) and `undirected_edge_labels`."""
        spec = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8"))
        if not isinstance(spec, dict) or not {"vertices", "edges"} <= set(spec):
            raise SchemaError("a schema needs the keys 'vertices' and 'edges'")
        leaves: dict[str, str] = {}
        supers: dict[str, list[str]] = {}
        for label, value in spec["vertices"].items():
            if isinstance(value, dict):
                if any(isinstance(v, dict) for v in value.values()):
                    raise SchemaError(f"super-label {label!r} nests more than one level")
                supers[label] = list(value)
                leaves |= value
            else:
                leaves[label] = value
        edges = []
        for label, files in spec["edges"].items():
            for f in [files] if isinstance(files, str) else files:
                m = _EDGE_FILE.fullmatch(Path(f).name)
                if not m:
                    raise SchemaError(f"edge file {f!r} is not named Src_label_Dst.csv")
                edges.append(EdgeTable(label, m["src"], m["dst"], f))
        return cls(leaves, supers, edges, set(spec.get("undirected_edge_labels", [])))

    def to_json(self) -> dict:
        inside = {x for own in self.supers.values() for x in own}
        files: dict[str, list[str]] = {}
        for e in self.edges:
            files.setdefault(e.label, []).append(e.file or f"{e.src}_{e.label}_{e.dst}.csv")
        return {
            "vertices": {k: v for k, v in self.leaves.items() if k not in inside} | {k: {x: self.leaves[x] for x in own} for k, own in self.supers.items()},
            "edges": {k: v if len(v) > 1 else v[0] for k, v in files.items()},
            "undirected_edge_labels": sorted(self.undirected),
        }
