import random
import re

import numpy as np
import pyarrow as pa

from weftgraph.llm import bytewords
from weftgraph.llm.bytewords import alphanumeric_words, nonspace_words, run_hashes, runs_per_text

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = [(nonspace_words, "[^\x20\x09-\x0d]+"), (alphanumeric_words, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def texts(seed):
    r = random.Random(seed)
    out = ["".join(r.choice("aB z\n\t9-é中\x0b\x00ÀK") for _ in range(r.randint(0, 30))) for _ in range(200)]
    return [*out, None, "", " ", "x", "x" * 5000, "word " * 3000, None]


def check(values, column):
    for make, pattern in KINDS:
        seen: dict = {}
        got = []
        for _, data, _, starts, ends, first, hashes in make().batches(column):
            for a, b in zip(first[:-1], first[1:], strict=True):
                got.append([data[s:e].tobytes().lower().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)])
                for w, h in zip(got[-1], hashes[a:b].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
        assert got == [re.findall(pattern, (t or "").translate(FOLD)) for t in values]
        assert len(set(seen.values())) == len(seen)


def test_words_and_hashes(monkeypatch):
    for block in (bytewords._BLOCK, 64):
        monkeypatch.setattr(bytewords, "_BLOCK", block)
        for kind in (pa.string(), pa.large_string()):
            values = texts(1)
            check(values, pa.array(values, type=kind))
            check(values[17:90], pa.array(values, type=kind)[17:90])
    assert list(nonspace_words().batches(pa.array([], type=pa.string()))) == []


def test_runs():
    w = np.arange(1, 8, dtype=np.uint64)
    assert len(run_hashes(w, 3)) == 5 and len(run_hashes(w, 9)) == 0
    assert run_hashes(w, 3)[1] == run_hashes(w[1:4], 3)[0] != run_hashes(w[1:3], 2)[0]
    assert [len(x) for x in runs_per_text(w, np.array([0, 2, 2, 7]), 3)] == [1, 0, 3]
