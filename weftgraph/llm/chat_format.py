"""Chat logs: collapse of cumulative snapshots, then rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import Scratch

#: Turn numbers in a block, and rows in a rendered part. Running hashes go block by block and
#: rendered text part by part, so that no task needs all turns of one conversation.
BLOCK = 256
#: A conversation of more parts than this is dealt by ranges of its rows; others are sorted in a row.
SORTED_PARTS = 4
#: Characters of a text that its place among the rows of one turn goes by.
ORDER_CHARS = 64

#: Whether a row has a turn number, and the number; rows without come first.
_TURN = ["numbered", "turn"]


def _turns(logs: DataFrame) -> DataFrame:
    return logs.where("conv_id is not null").select(
        "conv_id",
        F.col("turn").isNotNull().alias("numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(logs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each turn number of a conversation: hashes of everything up to it.

    (conv_id, numbered, turn, n, a, b, is_last): n rows of the conversation have this or an earlier
    turn; a and b are 128 bits of hash that roll from turn to turn, as exclusive or of hashes that
    hold the turn number, so blocks of turns can be hashed apart and put together.
    """
    rows = _turns(logs).select(
        "conv_id", *_TURN, F.xxhash64(*_TURN, "role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role", *_TURN).alias("b")
    )
    turns = (
        rows.distinct()
        .groupBy("conv_id", "numbered", F.floor(F.col("turn") / block).alias("blk"), "turn")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    )
    blocks = turns.groupBy("conv_id", "numbered", "blk").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    in_order = Window.partitionBy("conv_id").orderBy("numbered", "blk")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        "conv_id",
        "numbered",
        "blk",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"),
        F.lead("blk").over(in_order).isNull().alias("last_blk"),
    )
    within = Window.partitionBy("conv_id", "numbered", "blk").orderBy("turn")
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    local = turns.select(
        "conv_id",
        "numbered",
        "blk",
        "turn",
        F.sum("n").over(run).alias("n"),
        F.bit_xor("a").over(run).alias("a"),
        F.bit_xor("b").over(run).alias("b"),
        F.lead("turn").over(within).isNull().alias("last"),
    )
    return local.join(base, ["conv_id", "numbered", "blk"]).select(
        "conv_id",
        *_TURN,
        (F.col("n") + F.col("n0")).alias("n"),
        F.col("a").bitwiseXOR(F.col("a0")).alias("a"),
        F.col("b").bitwiseXOR(F.col("b0")).alias("b"),
        (F.col("last") & F.col("last_blk")).alias("is_last"),
    )


def maximal_conversations(logs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one continues; of equal ones, that
    with the smallest conv_id. Prefixes are equal when their number of rows and 128 bits of hash
    are."""
    hashes = prefix_hashes(logs, block)
    whole = hashes.where("is_last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("not is_last").select("n", "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def in_parts(rows: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """rows (conv_id and the sort keys of a conversation) with `part`: the rows of a conversation
    in order, `size` to a part, whatever their number.

    Rows are dealt by ranges of conversation and sort keys, so that a long conversation, or one
    turn of very many rows, goes to several tasks; a row's place is that in its range, after the
    rows of the conversation in the ranges before."""
    keys = [*_TURN, "role", "head", "digest"]
    dealt = scratch.save(rows.repartitionByRange("conv_id", *keys).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*keys)) - 1
    placed = dealt.withColumn("place", place).join(bases, ["conv_id", "range"])
    return placed.withColumn("part", F.floor((F.col("base") + F.col("place")) / size).cast("long")).drop("range", "base", "place")


def chat_format(logs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Collapse snapshots and render what is left.

    A conversation whose rows are the first rows of a longer one, up to some turn, is a snapshot of
    it and goes. Each kept conversation is rendered as `<|role|>\\n` text `\\n` per row, in order of
    turn, role and text (by its first ORDER_CHARS characters, then by its MD5 digest), cut into
    parts of `block` rows: (conv_id, part, n_turns, rendered); the parts in order make the whole.

    Defined cases: rows without conv_id belong to no conversation; rows without a turn number come
    before all others, those with a negative one too, and are a turn of their own; a null role is
    "unknown", a null text is empty; rows that repeat conv_id, turn, role and text count once;
    several roles or texts at one turn stand side by side, in parts if they are many. Texts are
    rendered whole, however long. Other columns are ignored, whatever their names. An empty table
    gives an empty table.
    """
    scratch = Scratch(logs.sparkSession)
    kept = scratch.save(maximal_conversations(logs, block), "kept")
    rows = _turns(logs).distinct().withColumn("head", F.substring("text", 1, ORDER_CHARS)).withColumn("digest", F.md5("text"))
    line = lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))
    in_order = F.array_sort(F.collect_list(F.struct(*_TURN, "role", "head", "digest", "text"))).alias("rows")
    few = F.col("n_turns") <= SORTED_PARTS * block
    whole = rows.join(kept.where(few), "conv_id").groupBy("conv_id", "n_turns").agg(in_order)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / block).cast("int")), lambda i: F.slice("rows", i * block + 1, F.lit(block)))
    out = whole.select("conv_id", "n_turns", F.posexplode(cut).alias("part", "rows"))
    long = kept.where(~few)
    if not long.isEmpty():
        parts = in_parts(rows.join(long, "conv_id"), scratch, block)
        out = out.unionByName(parts.groupBy("conv_id", "part", "n_turns").agg(in_order))
    return out.select("conv_id", F.col("part").cast("long").alias("part"), "n_turns", F.array_join(F.transform("rows", line), "").alias("rendered"))
