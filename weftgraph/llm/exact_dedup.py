"""Exact deduplication by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, fold_ascii, keep_probable, mark_probable

#: Characters that the prefix hash covers.
PREFIX_CHARS = 128


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Values of the keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Find documents with equal texts and choose the one with the largest id of each group.

    Texts are equal when they are the same after A-Z are lower-cased. Groups are refined step by
    step: by length, for all rows; by a hash of the first characters, for rows whose length
    repeats; and by the hash of the full text, for rows whose length and prefix both repeat. What
    is shuffled is lengths and hashes; texts never are. Which rows go on is told by bit tables of
    bounded size, which may let a few more through; these then are groups of one.

    Returns one row per input row: id_col, keep_id, group_size (long), kept, and the columns of
    `carry` ({name: expression over docs}), which are computed in the last scan.

    Defined cases: a null text counts as empty, and all empty texts are one group. Ids should be
    unique; rows that repeat an id and text are members of one group, and all with the largest id
    are kept. A row whose id is null is a member like others but never the one that stays unless
    its whole group has no id. A very long text is hashed whole where it must be, and never moved.
    An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    carry = carry or {}
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), fold_ascii(F.col(f"`{text_col}`")).alias("_t"), *[e.alias(f"_c_{n}") for n, e in carry.items()])
    # A-Z have as many bytes as a-z: lengths need no folding.
    length = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long")
    prefix = F.xxhash64(F.substring("_t", 1, PREFIX_CHARS))
    sized = src.withColumn("_len", F.octet_length("_t").cast("long"))

    lengths = scratch.save(_repeated(docs.select(length.alias("_len")), "_len"), "lengths")
    same_length = keep_probable(sized.select("_t", "_len"), F.col("_len"), lengths, F.col("_len"))
    prefixes = scratch.save(_repeated(same_length.select("_len", prefix.alias("_pre")), "_len", "_pre"), "prefixes")

    shape = F.struct("_len", "_pre")
    marked = mark_probable(sized, F.col("_len"), lengths, F.col("_len"), "_longer").withColumn("_pre", F.when(F.col("_longer"), prefix))
    marked = mark_probable(marked, F.when(F.col("_longer"), shape), prefixes, shape, "_again")
    # A row that needs no full hash has a key of its own, spread over all tasks.
    full = F.when(F.col("_again"), F.unhex(F.sha2("_t", 256))).otherwise(F.encode(F.concat_ws("#", F.lit(""), F.col("_id").cast("string"), F.col("_len").cast("string")), "utf-8"))
    # Written once, so that texts are not read a fourth time.
    rows = scratch.save(marked.select("_id", full.alias("_full"), "_again", "_len", *[f"_c_{n}" for n in carry]), "full-hashes")
    scratch.drop("lengths", "prefixes")
    groups = (
        rows.where("_again")
        .select("_full", "_len", "_id")
        .groupBy("_full", "_len")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .select(F.col("_full").alias("_g"), "_keep", "_size")
    )
    # Grouped by two columns and joined by one, the groups are dealt anew for this join, so that
    # adaptive execution can split the rows of a group that fills its partition.
    joined = rows.join(groups, F.col("_full") == F.col("_g"), "left")
    keep = F.coalesce("_keep", "_id")
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.expr("_keep is null or _id <=> _keep").alias("kept"),
        *[F.col(f"_c_{n}").alias(n) for n in carry],
    )
