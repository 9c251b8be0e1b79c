"""Best-fit packing of token sequences after dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import save, ship_code
from .tokens import encoder

CAPACITY = 2048

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)

Patterns = list[tuple[int, list[int]]]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Patterns, dict[int, int]]:
    """Fix sets that dominate every alternative, and return them with what is left.

    For an item j let k be the largest other item that fits beside it. {j} is fixed if nothing
    fits beside it. {j, k} is fixed if they fill the sequence, if no two other items fit beside j,
    or if no three do and k is at least as large as the best two together: in each case whatever
    else could stand beside j fits in the place of k, so some best packing has {j, k}. Else let b
    be the largest item that fits beside j and k. {j, k, b} is fixed if no three others fit beside
    j, and no two that are both larger than b: of any two that do, the larger one fits in the place
    of k and the smaller one in that of b. Items of a length are taken together, so the work
    depends on the number of lengths, not of items.
    """
    left = {j: n for j, n in counts.items() if n}
    lengths = sorted(left)
    fixed: Patterns = []

    def take(j: int, n: int) -> None:
        left[j] -= n
        if not left[j]:
            del left[j]
            del lengths[bisect_left(lengths, j)]

    def smallest(n: int, besides: int) -> list[int]:
        out: list[int] = []
        for x in lengths:
            out += [x] * min(left[x] - (x == besides), n - len(out))
            if len(out) >= n:
                break
        return out

    def largest(room: int, besides: int) -> int:
        i = bisect_left(lengths, room + 1) - 1
        if i >= 0 and lengths[i] == besides and left[besides] < 2:
            i -= 1
        return lengths[i] if i >= 0 else 0

    def larger_than(b: int, n: int, besides: int) -> list[int]:
        out: list[int] = []
        for x in lengths[bisect_left(lengths, b + 1) :]:
            out += [x] * min(left[x] - (x == besides), n - len(out))
            if len(out) >= n:
                break
        return out

    def third(room: int, j: int, k: int) -> int:
        """The largest item that fits in `room`, besides one of j and one of k."""
        for x in reversed(lengths[: bisect_left(lengths, room + 1)]):
            if left[x] > (x == j) + (x == k):
                return x
        return 0

    def best_two(room: int, besides: int) -> int:
        others = [x for x in lengths if x < room and (x != besides or left[x] > 1)]
        best = max((2 * x for x in others if 2 * x <= room and left[x] - (x == besides) > 1), default=0)
        lo, hi = 0, len(others) - 1
        while lo < hi:
            if others[lo] + others[hi] > room:
                hi -= 1
            else:
                best = max(best, others[lo] + others[hi])
                lo += 1
        return best

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                k = largest(room, j)
                if not k:
                    n = left[j] if room < j else 1
                    fixed.append((n, [j]))
                    take(j, n)
                    changed = True
                    continue
                few = smallest(3, j)
                dominates = k == room or len(few) < 2 or few[0] + few[1] > room
                no_three = len(few) < 3 or sum(few) > room
                if not dominates and no_three:
                    dominates = k >= best_two(room, j)
                if not dominates:
                    b = third(room - k, j, k) if no_three else 0
                    two = larger_than(b, 2, j) if b else []
                    if not b or len(two) == 2 and sum(two) <= room:
                        break
                    own = [j, k, b]
                    n = min(left[x] // own.count(x) for x in own)
                    fixed.append((n, own))
                    for x in own:
                        take(x, n)
                    changed = True
                    continue
                # Taking many at once must not change what the rule has looked at, but for items
                # becoming fewer, which leaves the alternatives fewer too.
                n = left[j] // 2 if j == k else min(left[j], left[k])
                fixed.append((n, [j, k]))
                take(j, n)
                take(k, n)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing over counts of lengths: each item goes where the least room is left.

    Sequences with the same content are kept as one pattern and a number, and items of a length
    are placed together, so memory and time do not depend on the number of items.
    """
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(n: int, items: list[int], room: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([n, items])

    for j in sorted(counts, reverse=True):
        n = counts[j]
        while n:
            i = bisect_left(rooms, j)
            if i == len(rooms):
                each = min(n, capacity // j)
                put(n // each, [j] * each, capacity - j * each)
                n -= n // each * each
                continue
            room = rooms[i]
            groups = open_[room]
            number, items = groups.pop()
            if not groups:
                del open_[room]
                del rooms[i]
            each = min(n, room // j)
            many = min(number, n // each)
            put(number - many, items, room)
            put(many, items + [j] * each, room - j * each)
            n -= many * each
    return [(n, items) for groups in open_.values() for n, items in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """(number of sequences, lengths in each) that hold all items."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def seats(patterns: Patterns) -> np.ndarray:
    """Where items sit: rows (length, first rank, first sequence, offset), sorted. The items of a
    length with ranks from the first on sit in consecutive sequences at that offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for n, items in patterns:
        offset = 0
        for j in items:
            rows.append((j, ranks.get(j, 0), sequence, offset))
            ranks[j] = ranks.get(j, 0) + n
            offset += j
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` tokens: a document's ids and then `end`. Only a longer one is
    cut, into full pieces; what is over comes first. ids are little-endian unsigned 32-bit."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_code(docs.sparkSession)
    arrow = to_arrow_schema(PIECES)

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1)), strict=True):
                raw = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                n = len(raw) // 4
                cut = n if n <= capacity else n % capacity or capacity
                start = 0
                for piece in range(1 + (n - cut) // capacity):
                    own = raw[4 * start : 4 * cut]
                    for column, v in zip(out, (doc, piece, start, cut - start, zlib.crc32(own), own if with_ids else None), strict=True):
                        column.append(v)
                    start, cut = cut, cut + capacity
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
                    out = [[] for _ in PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank from 0 among those of their length. A length that many pieces have
    is ranked in as many buckets as there are shuffle partitions, each from where the one before
    it ends."""
    buckets = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("_l"), F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = keyed.withColumn("_r", F.row_number().over(own) - 1)
    joined = numbered.join(bases, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_k")))
    return joined.select(*pieces.columns, (F.col("_r") + F.col("_base")).alias("_rank"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if
    `with_ids`. The driver sees the number of pieces of each length, at most `capacity` numbers,
    and plans patterns of lengths by dominance reduction and best fit; pieces then find their
    places by their rank among those of their length. The plan has a row for each place in a
    pattern, and the number of patterns depends on the lengths alone, so it is broadcast.

    Whole texts are encoded, however long. Defined cases: a null or empty text is a document of the
    end token alone; pieces of a length are placed in order of document and piece; rows that repeat a
    document are packed each; a null id stays null; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = docs.sparkSession
    pieces = save(tokenize(docs, tokenizer, id_col, text_col, capacity, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    table = spark.sparkContext.broadcast(seats(plan(counts, capacity)))
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows = table.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            at = b.schema.get_field_index
            length, rank = b.column(at("length")).to_numpy(zero_copy_only=False), b.column(at("_rank")).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            new = [pa.array(rows[i, 2] + rank - rows[i, 1]), pa.array(rows[i, 3])]
            yield pa.RecordBatch.from_arrays([*[b.column(at(f.name)) for f in PIECES], *new], schema=arrow)

    out = ranked(pieces).mapInArrow(place, schema)
    return out if with_ids else out.drop("ids")
