"""Jaccard join of documents over word n-grams, in size-banded tiles with bitmap signatures.

Sets of equal content are one class, of which one document goes on. A class is posted under the
first entries of its set in a global order in which frequent n-grams come last; two sets that are
similar enough share one of these entries. Classes under the same entry, cut where sizes are too
far apart, make a tile. In a tile, bitmap signatures bound the overlap of two sets from above, and
what passes is verified by exact intersection of the sorted sets.

Of a tile, first only the most promising partner of each class is verified. When those links have
been joined to components, every pair of a tile that is still in two components and passes the bound
is verified too. So all links between components are found, while a large group of near copies
needs about one pair for each member and not all its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, nonspace_words, run_hashes, runs_per_text
from .cluster import Scratch, keep_probable, ship_code
from .components import connected_components

#: At most so many n-grams are called frequent: each has at least this part of all occurrences.
FREQUENT = 1 << 18
#: ... and at least so many occurrences.
LEAST_FREQUENT = 64
#: A task counts so many n-grams at a time, and says nothing about one that occurs fewer than LOCAL
#: times among them. This is for the order alone; what is posted is counted exactly.
COUNTED = 4_000_000
LOCAL = 4
#: Classes of an entry that one task gathers; an entry with more is dealt to more tasks.
TILE = 4096
#: Pairs of a document that one task verifies; one in more pairs is sent to more tasks.
PARTNERS = 64
#: So many rows of two longs at most are broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
#: Classes of a tile; longer lists are cut into blocks of half as many, which meet in pairs.
BLOCK = 512
#: Bits of a signature for each member of a set, and the most bits. With one bit for a member the
#: bound tells most pairs below a similarity of 0.82 from those of 0.85.
BITS_PER_MEMBER = 1
MOST_BITS = 1 << 15


def signature_bits(n: int) -> int:
    """Bits of the signature in the size band of n: a power of two."""
    return min(MOST_BITS, max(64, 1 << (BITS_PER_MEMBER * n - 1).bit_length()))


def signature(members: np.ndarray, n_bits: int) -> np.ndarray:
    """Parity of the number of members hashed to each bit: two sets differ in at least as many
    members as their signatures differ in bits."""
    at = (members ^ (members >> np.uint64(33))) & np.uint64(n_bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=n_bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n_words: int) -> np.ndarray:
    """Signatures of the band below: the two halves by exclusive or."""
    while words.shape[-1] > n_words:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def similar(shared, size_a, size_b, num: int, den: int):
    """Whether shared / (size_a + size_b - shared) >= num / den, in whole numbers."""
    return (num + den) * shared >= num * (size_a + size_b)


def word_sets(texts, n: int):
    """Sorted distinct hashes of the n-grams of each text of an Arrow array."""
    for _, _, _, _, _, first, hashes in nonspace_words().batches(texts):
        for runs in runs_per_text(hashes, first, n):
            yield np.unique(runs)


def frequent_ngrams(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of frequent n-grams, by hash. Any common choice gives the same links; this
    one keeps tiles small. At most FREQUENT reach the driver."""
    ship_code(texts.sparkSession)

    def counted(found: list[np.ndarray]):
        import pyarrow as pa

        every = np.concatenate([np.zeros(0, np.uint64), *found])
        total = len(every)
        found.clear()
        every.sort()
        # Where LOCAL equal ones stand in a row, their run is looked at; most n-grams occur once.
        seen = np.flatnonzero(every[LOCAL - 1 :] == every[: total - LOCAL + 1]) if total >= LOCAL else np.zeros(0, np.int64)
        keys = np.unique(every[seen])
        counts = np.searchsorted(every, keys, side="right") - np.searchsorted(every, keys)
        key = pa.array(np.append(keys.view(np.int64), 0), mask=np.append(np.zeros(len(keys), bool), True))
        return pa.RecordBatch.from_arrays([key, pa.array(np.append(counts, total).astype(np.int64))], names=["g", "c"])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for _, _, _, _, _, first, hashes in nonspace_words().batches(batch.column(0)):
                runs = run_hashes(hashes, n)
                last = first[1:][np.diff(first) > 0]
                inside = np.ones(len(runs), dtype=bool)
                for k in range(1, n):
                    at = last - k
                    inside[at[(at >= 0) & (at < len(runs))]] = False
                found.append(runs[inside])
                held += len(found[-1])
            if held >= COUNTED:
                yield counted(found)
                held = 0
        yield counted(found)

    scratch = Scratch(texts.sparkSession)
    counts = scratch.save(texts.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "ngram-counts")
    total = counts.where("g is null").agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    rows = counts.where(F.col("g").isNotNull() & (F.col("c") >= max(LEAST_FREQUENT, total // FREQUENT + 1))).toArrow()
    scratch.drop("ngram-counts")
    keys, c = rows.column("g").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


_FEATURES = "id long, n long, h1 long, h2 long, prefix array<long>, bits binary"


def features(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n: int, num: int, den: int) -> DataFrame:
    """For each document its set's size, two hashes of the set, the first entries of the set in the
    global order, and the signature."""
    keys, counts = frequent
    shipped = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches):
        import pyarrow as pa

        keys, counts = shipped.value
        for batch in batches:
            sizes, h1, h2, prefixes, bits = [], [], [], [], []
            for members in word_sets(batch.column(1), n):
                size = len(members)
                sizes.append(size)
                h1.append(int((mix(members + np.uint64(size)).sum() if size else np.uint64(0)).view(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if size else 0)
                bits.append(signature(members, signature_bits(size)).tobytes() if size else b"")
                if size and len(keys):
                    at = np.searchsorted(keys, members)
                    at[at == len(keys)] = 0
                    often = keys[at] == members
                    if often.any():
                        late = members[often][np.argsort(counts[at[often]], kind="stable")]
                        members = np.concatenate([members[~often], late])
                prefixes.append(members[: size - -(-num * size // den) + 1].view(np.int64) if size else members[:0].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "h1", "h2", "prefix", "bits"])

    return docs.mapInArrow(run, _FEATURES)


def _groups(batches, keys: list[str]):
    """Whole runs of equal keys in sorted Arrow batches: (table, where its runs begin, with its end).
    Batches are put together only where a run ends, so a long run is copied once."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(len(table), dtype=bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
            change[0] |= bool(held) and c[0] != held[-1].column(k)[-1].as_py()
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(table)
            continue
        last = int(starts[-1])
        yield _with_starts(pa.concat_tables([*held, table.slice(0, last)]).combine_chunks(), keys)
        held = [table.slice(last)]
    if held:
        yield _with_starts(pa.concat_tables(held).combine_chunks(), keys)


def _with_starts(table, keys: list[str]):
    change = np.zeros(len(table), dtype=bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return table, np.append(np.flatnonzero(change), len(table))


def _blocks(begin: int, end: int, sizes: np.ndarray, sides: np.ndarray, num: int, den: int):
    """A list of classes as tiles of BLOCK: (places, sides, defer). Blocks of half a tile are
    compared within and with each other; pairs of blocks but for those with the first are deferred,
    to be looked at when the others' links are known."""
    half = BLOCK // 2
    cuts = [*range(begin, end, half), end]
    one_side = (sides[begin:end] == sides[begin]).all()
    for i in range(len(cuts) - 1):
        own = np.arange(cuts[i], cuts[i + 1])
        yield own, sides[own], False
        for j in range(i + 1, len(cuts) - 1):
            if den * sizes[own[-1]] < num * sizes[cuts[j]]:
                break
            other = np.arange(cuts[j], cuts[j + 1])
            both = np.concatenate([own, other])
            # Classes of two sides stay so; of one side, a block is a side.
            yield both, np.repeat(np.array([0, 1], dtype=sides.dtype), [len(own), len(other)]) if one_side else sides[both], i > 0


def tile_lists(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Tiles from postings (g, i, j, side, id, n): lists of classes, cut where sizes are too far
    apart and into blocks, each list once. Tiles of a dealt entry, and of two blocks, hold a side
    for each class: only classes of different sides are to be compared, or all if there is one."""

    def run(batches):
        import pyarrow as pa

        for table, starts in _groups(batches, ["g", "i", "j"]):
            ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
            sides = table.column("side").to_numpy()
            # Within an entry rows are sorted by size; a tile ends where the next size is too large.
            cut = np.zeros(len(ids), dtype=bool)
            cut[starts[:-1]] = True
            cut[1:] |= den * sizes[:-1] < num * sizes[1:]
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(ids))
            many = end - begin > 1
            begin, end = begin[many], end[many]
            whole = end - begin <= BLOCK
            keep = [np.arange(a, b) for a, b in zip(begin[whole].tolist(), end[whole].tolist(), strict=True)]
            own = [sides[k] for k in keep]
            defer = [False] * len(keep)
            for a, b in zip(begin[~whole].tolist(), end[~whole].tolist(), strict=True):
                for k, side, later in _blocks(a, b, sizes, sides, num, den):
                    keep.append(k)
                    own.append(side)
                    defer.append(later)
            if not keep:
                continue
            cuts = np.concatenate([[0], np.cumsum([len(k) for k in keep])])
            keep, own = np.concatenate(keep), np.concatenate(own)
            mixed = mix(ids[keep].view(np.uint64) * np.uint64(2) + own.astype(np.uint64) + np.uint64(0x51ED27))
            k1, k2 = np.add.reduceat(mixed, cuts[:-1]), np.bitwise_xor.reduceat(mix(mixed), cuts[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (ids[keep], own)]
            columns = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *lists, pa.array(defer)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "ids", "sides", "defer"])

    lists = postings.mapInArrow(run, "k1 long, k2 long, ids array<long>, sides array<int>, defer boolean")
    return lists.groupBy("k1", "k2").agg(F.first("ids").alias("ids"), F.first("sides").alias("sides"), F.min("defer").alias("defer"))


class Tile:
    """Classes of one tile by size, with their signatures by band."""

    def __init__(self, sizes: np.ndarray, sides: np.ndarray, bits: list[bytes]):
        self.sizes, self.sides = sizes, sides
        widths = np.array([len(b) // 8 for b in bits])
        self.widths = widths
        self.rows = {}
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            self.rows[w] = (at, np.frombuffer(b"".join(bits[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), w))
        self.one_side = (sides == sides[0]).all()

    def partners(self, i: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Earlier, so not larger, classes that may be similar to class i, and the number of bits
        in which each one's signature differs."""
        at, own = self.rows[int(self.widths[i])]
        mine = own[np.searchsorted(at, i)]
        out, bits = [], []
        for w, (at, words) in self.rows.items():
            if w > self.widths[i]:
                continue
            lo, hi = np.searchsorted(self.sizes[at], -(-num * int(self.sizes[i]) // den)), np.searchsorted(at, i)
            if lo >= hi:
                continue
            differ = np.bitwise_count(words[lo:hi] ^ fold(mine, w)).sum(1, dtype=np.int64)
            who = at[lo:hi]
            ok = similar((self.sizes[who] + self.sizes[i] - differ) // 2, self.sizes[who], self.sizes[i], num, den)
            if not self.one_side:
                ok &= self.sides[who] != self.sides[i]
            out.append(who[ok])
            bits.append(differ[ok])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(bits)


def candidate_pairs(tiles: DataFrame, num: int, den: int, all_pairs: bool) -> DataFrame:
    """Rows (a, b, open) from tile rows (k1, k2, id, n, side, bits, comp), sorted by tile and size.

    With open = false, (a, b) is a pair to verify: of each class its most promising partner, or all
    partners of other components. With open = true, (a, b) names a tile where a class has more
    partners than the one given, so that more may be left to verify there."""

    def run(batches):
        import pyarrow as pa

        for table, starts in _groups(batches, ["k1", "k2"]):
            ids, sizes = table.column("id").to_numpy(), table.column("n").to_numpy()
            k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
            sides, comps, bits = table.column("side").to_numpy(), table.column("comp").to_numpy(), table.column("bits").to_pylist()
            a, b, left = [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo < 2 or all_pairs and (comps[lo:hi] == comps[lo]).all():
                    continue
                tile = Tile(sizes[lo:hi], sides[lo:hi], bits[lo:hi])
                own, comp, more = ids[lo:hi], comps[lo:hi], False
                for i in range(1, hi - lo):
                    who, differ = tile.partners(i, num, den)
                    if all_pairs:
                        who = who[comp[who] != comp[i]]
                    elif len(who):
                        more |= len(who) > 1
                        who = who[differ.argmin()][None]
                    other = own[who]
                    a += np.minimum(other, own[i]).tolist()
                    b += np.maximum(other, own[i]).tolist()
                    left += [False] * len(who)
                if more:
                    a.append(int(k1[lo]))
                    b.append(int(k2[lo]))
                    left.append(True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left, pa.bool_())], names=["a", "b", "open"])

    return tiles.mapInArrow(run, "a long, b long, open boolean").where("a <> b or open").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they have been counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def verify(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by intersection of the sorted sets. Texts are read
    again, of the documents in pairs only."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = keep_probable(docs.where("id is not null"), F.col("id"), members, F.col("id"))
    # A document of very many pairs is there in several copies, each for a part of its pairs.
    many = _small(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PARTNERS).select("id", F.ceil(F.col("n") / PARTNERS).alias("copies")))
    copies = lambda df, key: df.join(many.withColumnRenamed("id", key), key, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    texts = copies(texts, "id").select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    # Rows that repeat count once; dealt by id and copy, which the joins need as well.
    texts = texts.repartition("id", "copy").dropDuplicates(["id", "copy", "text"])
    part = lambda other: F.pmod(F.xxhash64(other), F.col("copies"))
    both = copies(copies(pairs, "a").withColumn("pa", part("b")).drop("copies"), "b").withColumn("pb", part("a")).drop("copies")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("copy").alias("pa"), F.col("text").alias("ta")), ["a", "pa"])
    both = both.join(texts.select(F.col("id").alias("b"), F.col("copy").alias("pb"), F.col("text").alias("tb")), ["b", "pb"]).select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(word_sets(batch.column(2), n), word_sets(batch.column(3), n), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(len(x) and len(y) and similar(shared, len(x), len(y), num, den)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def dealt_entries(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings (g, i, j, side, id, n) of the classes' prefixes.

    Entries are counted, exactly and over all tasks. One with more classes than a task gathers is
    dealt: each class has a part, and parts meet in pairs, so each is there as often as there are
    parts."""
    entries = reps.select("id", "n", F.explode("prefix").alias("g"))
    many = entries.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > TILE)
    hot = scratch.save(many.select("g", F.ceil(F.col("c") / TILE).cast("int").alias("parts")), "hot-entries")
    if hot.isEmpty():
        return entries.select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "n")
    entries = entries.join(_small(hot), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    entries = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return entries.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "n")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least num / den.

    A document's set is its distinct n-word sequences, or all its words if they are fewer than n;
    words are runs of anything but blanks, with A-Z in lower case. Returns a row per document:
    id_col, n_shingles, component_id, the smallest id reachable by links.

    Defined cases: a document without text or words has an empty set and is linked with nothing; a
    row without id is returned with a null component and links nothing; repeated rows are each
    returned, and rows that share an id are versions of one document, whose links are those of all;
    very long texts are read whole; a similarity of exactly num / den links; other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    ship_code(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    save = scratch.save
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = save(features(src, frequent_ngrams(src.select("text"), n), n, num, den), "features")

    named = known.where("id is not null and n > 0")
    classes = save(named.select("h1", "h2", "id").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    # One document of each class goes on.
    reps = save(named.join(classes.select(F.col("rep").alias("id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "id").where("h1 = _h1 and h2 = _h2").select("id", "n", "h1", "h2", "prefix", "bits").dropDuplicates(["id", "h1", "h2"]), "classes-features")
    # Versions of one document are linked: an id of several classes, with the document of each.
    own = F.struct("h1", "h2")
    several = named.groupBy("id").agg(F.min(own).alias("c0"), F.max(own).alias("c1")).where("c0 <> c1").select("id")
    versions = named.select("id", "h1", "h2").join(several, "id", "left_semi").join(classes, ["h1", "h2"]).where("id <> rep")
    versions = save(versions.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "versions")

    postings = dealt_entries(reps, scratch).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "n", "id", "side")
    # A row for each tile: one that is not looked at again is never taken apart.
    lists = save(tile_lists(postings, num, den), "tiles")
    signed = reps.select("id", "n", "bits")

    def members(tiles: DataFrame) -> DataFrame:
        apart = tiles.select("k1", "k2", F.explode(F.arrays_zip("ids", "sides")).alias("m"))
        return apart.select("k1", "k2", F.col("m.ids").alias("id"), F.col("m.sides").alias("side"))

    def sorted_tiles(rows: DataFrame) -> DataFrame:
        return rows.select("k1", "k2", "id", "n", "side", "bits", "comp").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "n", "id", "side")

    found = save(candidate_pairs(sorted_tiles(members(lists.where("not defer")).join(signed, "id").withColumn("comp", F.col("id"))), num, den, all_pairs=False), "first-pairs")
    first = found.where("not open").select("a", "b")
    links = save(verify(first, src, n, num, den), "first-links")
    comp = connected_components(links.unionByName(versions))
    # Tiles where something may be left: those with a class that had a choice of partners and those
    # put off, as far as they have classes of two components.
    chosen = lists.where("not defer").join(_small(found.where("open").select(F.col("a").alias("k1"), F.col("b").alias("k2"))), ["k1", "k2"], "left_semi")
    some = members(chosen.unionByName(lists.where("defer"))).join(comp.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    some = save(some.select("k1", "k2", "id", "side", "comp"), "tiles-left")
    apart = save(some.groupBy("k1", "k2").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("k1", "k2"), "tiles-apart")
    some = some.join(_small(apart), ["k1", "k2"], "left_semi")
    rest = candidate_pairs(sorted_tiles(some.join(signed, "id")), num, den, all_pairs=True).select("a", "b").join(first, ["a", "b"], "left_anti")
    rest = save(rest, "other-pairs")
    more = save(verify(rest, src, n, num, den), "other-links")
    # Links between components, put under the components' names.
    ends = more.join(comp.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(comp.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    merged = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    scratch.drop("classes-features", "versions", "hot-entries", "tiles", "first-pairs", "first-links", "tiles-left", "tiles-apart", "other-pairs", "other-links")
    final = classes.join(comp.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    final = final.join(merged.withColumnsRenamed({"node": "c"}), "c", "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "c").alias("component_id"))
    # Both sides are dealt for this join, so that adaptive execution can split the rows of a large
    # class. Rows without a class are spread by a key of their own.
    light = known.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("h1")).otherwise(F.xxhash64("id", "h1")).alias("h1"), "h2")
    out = light.join(final, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
