"""Benchmark decontamination by a broadcast set of hashed test n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import alphanumeric_words, run_hashes
from .cluster import Scratch, add_columns, mark_probable, named, numbered, ship_code, without

WINDOW = 13
#: So many characters of benchmark texts at most are broadcast at once, as an index of some 7 bytes
#: for each; a larger benchmark is scanned for in blocks of this size, one job after the other.
BLOCK_CHARS = 8_000_000
#: Words of an item that go to one block; a longer item is split, with the overlap of a window.
PIECE_WORDS = 100_000
#: A document is contaminated when at least one in so many of its words is hit.
ONE_IN = 20

FIELDS = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("_hits", T.ArrayType(T.LongType())),
]


class WindowIndex:
    """Windows of `n` words of benchmark items by hash, as arrays.

    For each size of window: sorted hashes, the place of the window's first word, and the items that
    have it. Words are places in one run of bytes, by which a hit is verified."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import pyarrow as pa

        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        raw, starts, ends, base, words = [], [], [], 0, 0
        found: dict[int, list] = {}
        texts = pa.array([t for _, t in items], type=pa.large_string())
        for i, data, _, s, e, first, hashes in alphanumeric_words().batches(texts):
            counts = np.diff(first)
            item = np.array([number[x] for x, _ in items[i : i + len(counts)]], dtype=np.int32)
            whole = run_hashes(hashes, n)
            at = np.arange(len(whole))
            owner = np.searchsorted(first, at, side="right") - 1
            inside = at + n <= first[owner + 1]
            found.setdefault(n, []).append((whole[inside], at[inside] + words, item[owner[inside]]))
            for d in np.flatnonzero((counts > 0) & (counts < n)).tolist():
                a, b = int(first[d]), int(first[d + 1])
                found.setdefault(b - a, []).append((run_hashes(hashes[a:b], b - a), np.array([a + words]), item[d : d + 1]))
            raw.append(data.tobytes().lower())
            starts.append((s + base).astype(np.int64))
            ends.append((e + base).astype(np.int64))
            base, words = base + len(data), words + len(s)
        none = np.zeros(0, np.int64)
        self.raw, self.starts, self.ends = b"".join(raw), np.concatenate([none, *starts]).astype(np.uint32), np.concatenate([none, *ends]).astype(np.uint32)
        self.sizes = {size: self._grouped(size, *[np.concatenate(x) for x in zip(*parts, strict=True)]) for size, parts in found.items()}

    def words(self, at: int, size: int) -> list[bytes]:
        return [self.raw[s:e] for s, e in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist(), strict=True)]

    def _grouped(self, size: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first words, where each one's items begin, items): each window once, by hash."""
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(hashes))
        # Most hashes occur once. Of the others, places with the same words are one window.
        for b, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
            by_words: dict[tuple, list] = {}
            for k in range(b, e):
                by_words.setdefault(tuple(self.words(int(at[k]), size)), []).append(k)
            sorted_ = [k for own in by_words.values() for k in own]
            at[b:e], item[b:e] = at[sorted_], item[sorted_]
            k = b
            for own in by_words.values():
                new[k] = True
                k += len(own)
        first = np.flatnonzero(new)
        return hashes[first], at[first].astype(np.uint32), np.append(first, len(hashes)).astype(np.uint32), item

    def scan(self, texts) -> tuple[list, list, list]:
        """For each text: its number of words, the item ids found, and the runs of hit words as
        [first word, end, first byte, end, ...]."""
        n_words, items, runs = [], [], []
        for _, data, cuts, starts, ends, first, hashes in alphanumeric_words().batches(texts):
            at = len(n_words)
            n_words += np.diff(first).tolist()
            items += [set() for _ in range(len(first) - 1)]
            runs += [[] for _ in range(len(first) - 1)]
            found = []
            low = None
            for size, (keys, places, begins, names) in self.sizes.items():
                windows = run_hashes(hashes, size)
                if not len(windows) or not len(keys):
                    continue
                place = np.searchsorted(keys, windows)
                place[place == len(keys)] = 0
                hit = np.flatnonzero(keys[place] == windows)
                owner = np.searchsorted(first, hit, side="right") - 1
                inside = hit + size <= first[owner + 1]
                for w, p, d in zip(hit[inside].tolist(), place[hit[inside]].tolist(), owner[inside].tolist(), strict=True):
                    if low is None:
                        low = data.tobytes().lower()
                    own = [low[s:e] for s, e in zip(starts[w : w + size].tolist(), ends[w : w + size].tolist(), strict=True)]
                    while p < len(keys) and keys[p] == windows[w]:
                        if self.words(int(places[p]), size) == own:
                            items[at + d].update(names[begins[p] : begins[p + 1]].tolist())
                            found.append((w, w + size, d))
                            break
                        p += 1
            for w, end, d in sorted(found):
                own, base = runs[at + d], int(first[d])
                if own and w - base <= own[-3]:
                    own[-3] = max(own[-3], end - base)
                else:
                    own += [w - base, end - base, 0, 0]
            for d in {d for _, _, d in found}:
                own, base = runs[at + d], int(first[d])
                for k in range(0, len(own), 4):
                    own[k + 2] = int(starts[base + own[k]] - cuts[d])
                    own[k + 3] = int(ends[base + own[k + 1] - 1] - cuts[d])
        return n_words, [sorted(self.names[k] for k in x) for x in items], runs


def item_pieces(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(i, t): items with text, each once; one of very many words as several pieces, which overlap
    by a word less than a window, so that each window is in a piece."""
    ship_code(benchmark.sparkSession)
    step = max(PIECE_WORDS, window)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = [text.as_py()]
                if len(pieces[0]) > step:
                    (_, data, _, starts, ends, _, _), *_ = alphanumeric_words().batches(pa.array([text.as_py()], pa.large_string()))
                    if len(starts) > step:
                        raw = data.tobytes()
                        begins = range(0, len(starts) - window + 1, step)
                        pieces = [raw[starts[a] : ends[min(a + step + window - 1, len(starts)) - 1]].decode() for a in begins]
                names += [name] * len(pieces)
                texts += pieces
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["i", "t"])

    wanted = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    return wanted.mapInArrow(run, "i string, t string").distinct()


def _blocks(pieces: DataFrame, block_chars: int) -> list[DataFrame]:
    """The pieces in blocks of at most block_chars characters; a longer piece is a block.

    Pieces are dealt to buckets by hash, in more and smaller ones until each bucket fits, and the
    driver puts buckets together by their sizes."""
    size = F.length("t")
    total = pieces.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= block_chars:
        return [pieces]
    n = 8 * -(-int(total) // block_chars)
    while True:
        bucket = F.pmod(F.xxhash64("i", "t"), F.lit(n))
        sizes = {r.b: (r.s, r.n) for r in pieces.groupBy(bucket.alias("b")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        if all(s <= block_chars or k == 1 for s, k in sizes.values()):
            break
        n *= 2
    blocks: list[list[int]] = []
    room = -1
    for b, (s, _) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        if s > room:
            blocks.append([])
            room = block_chars
        blocks[-1].append(b)
        room -= s
    return [pieces.where(bucket.isin(own)) for own in blocks]


def _merged(runs: list) -> list:
    """Runs of several blocks in order, without overlaps."""
    out: list = []
    for w, end, s, e in sorted(tuple(runs[k : k + 4]) for k in range(0, len(runs), 4)):
        if out and w <= out[-3]:
            if end > out[-3]:
                out[-3], out[-1] = end, e
        else:
            out += [w, end, s, e]
    return out


def cut_runs(text: str, runs: list[int]) -> str:
    """The text without the bytes of the runs."""
    raw, out, end = text.encode(), [], 0
    for k in range(0, len(runs), 4):
        out.append(raw[end : runs[k + 2]])
        end = runs[k + 3]
    return b"".join([*out, raw[end:]]).decode()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs with what of the benchmark is in them.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z in lower
    case. An item's windows are its runs of `window` words, or all its words if they are fewer.
    Windows are found by hash and verified word by word.

    Adds _n_words, _n_hit (words inside any occurrence), _items (sorted ids, as strings, of the
    items found), _hits (runs of hit words: first word, end, first byte, end, one after the other)
    and _contaminated (_n_hit > 0 and 20 * _n_hit >= _n_words). The benchmark's size is measured
    first. One of up to `block_chars` characters is broadcast and nothing is shuffled. A larger one
    is broadcast block by block: each block has a job that writes the hits of texts that have any,
    and its index is gone before the next begins; in the end the rows that have hits, and few
    others, are dealt by a hash of their texts to meet them.

    Defined cases: a null or empty text has no words; items without words or id are left out; equal
    items are each found, and items repeated under one id once; overlapping hits count each word
    once; documents that repeat each have a row; very long texts and items are scanned whole, the
    latter in pieces that overlap; an input column with the name of a result is replaced, and other
    names do not clash; empty tables give no hits, or no rows.
    """
    own = ["_n_words", "_n_hit", "_items", "_hits", "_contaminated"]
    spark, plain = docs.sparkSession, without(docs, own)
    blocks = _blocks(item_pieces(benchmark, item_id, item_text, window), block_chars)

    def broadcast(block: DataFrame):
        return spark.sparkContext.broadcast(WindowIndex([(r.i, r.t) for r in block.collect()], window))

    if len(blocks) == 1:
        index = broadcast(blocks[0])

        def make(batches):
            for (texts,) in batches:
                yield list(index.value.scan(texts))

        out = add_columns(plain, make, FIELDS, [text_col])
    else:
        out = _find_in_blocks(plain, [lambda b=b: broadcast(b) for b in blocks], text_col)
    n_hit = F.expr("aggregate(sequence(0, cast(size(_hits) / 4 as int)), 0L, (s, i) -> s + coalesce(get(_hits, 4 * i + 1) - get(_hits, 4 * i), 0L))")
    out = out.withColumn("_n_hit", n_hit)
    return out.withColumn("_contaminated", F.expr(f"_n_hit > 0 and {ONE_IN} * _n_hit >= _n_words"))


def _find_in_blocks(docs: DataFrame, indexes: list, text_col: str) -> DataFrame:
    """docs with FIELDS, from one index at a time. Hits belong to a text, which is known by 128 bits
    of hash."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    keys = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("h2"), text)}
    texts = docs.select(text.cast("string").alias("t"), *[e.alias(k) for k, e in keys.items()]).where("t is not null")
    found = None
    for k, broadcast in enumerate(indexes):
        index = broadcast()

        def run(batches, index=index):
            import pyarrow as pa

            for b in batches:
                _, items, runs = index.value.scan(b.column(0))
                hit = pa.array([bool(r) for r in runs], pa.bool_())
                columns = [b.column(1), b.column(2), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "items", "runs"]).filter(hit)

        hits = texts.mapInArrow(run, "h1 long, h2 long, items array<string>, runs array<long>")
        hits = scratch.save(hits.groupBy("h1", "h2").agg(F.first("items").alias("items"), F.first("runs").alias("runs")), f"hits-{k}")
        index.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = scratch.save(found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs")), "hits")
    scratch.drop(*[f"hits-{k}" for k in range(len(indexes))])
    key = F.struct("h1", "h2")
    marked = mark_probable(numbered(docs, **keys), key, found, key, "probable")
    sure = marked.where("not probable").withColumns({"items": F.lit(None).cast("array<string>"), "runs": F.lit(None).cast("array<long>")})
    rest = marked.where("probable").join(found, ["h1", "h2"], "left")
    place = f"c{docs.columns.index(text_col)}"

    def make(batches):
        words = alphanumeric_words()
        for texts, items, runs in batches:
            n_words = [n for *_, first, _ in words.batches(texts) for n in np.diff(first).tolist()]
            yield [n_words, [sorted(set(x or [])) for x in items.to_pylist()], [_merged(x or []) for x in runs.to_pylist()]]

    out = add_columns(sure.unionByName(rest), make, FIELDS, [place, "items", "runs"])
    return named(out, docs, *[f.name for f in FIELDS])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with the hit words cut out of
    every text (remove="spans"), from a run's first word to its last. Columns and rows are else as
    they were, whatever the columns' names; cases are those of find_contamination()."""
    place = f"c{docs.columns.index(text_col)}"
    found = find_contamination(numbered(docs), benchmark, place, **options)
    if remove == "documents":
        return named(found.where("not _contaminated"), docs)
    if remove != "spans":
        raise ValueError(f"remove: {remove!r} is neither 'documents' nor 'spans'")

    def make(batches):
        for texts, hits in batches:
            yield [[cut_runs(t, h) if h else t for t, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True)]]

    cut = add_columns(found, make, [T.StructField("_cut", T.StringType())], [place, "_hits"])
    return named(cut.withColumn(place, F.col("_cut")), docs)
