"""A corpus pipeline: toxicity, boilerplate lines, near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again for the next one. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.cluster import Scratch, anti_join, named, numbered, save
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.jaccard import jaccard_classes
from weftgraph.llm.line_dedup import line_dedup
from weftgraph.llm.packing import pack
from weftgraph.llm.registry import byte_bpe
from weftgraph.llm.toxicity import fit_chain, score_toxicity

#: Near duplicates share this part of their five-word sequences.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. Others stay, those of low quality too.

    A null or empty text is scored by the biases alone; repeated rows go or stay together; without
    labels nothing goes; whole texts are scored, however long; columns of docs stay as they are,
    whatever their names; an empty table gives an empty table."""
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(numbered(docs), chain, f"c{docs.columns.index('text')}")
    return named(scored.where("not _is_toxic"), docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source are cut out; every document stays, and n_chars of
    a text that was cut is its new length.

    Cases are those of line_dedup(): a null text stays null, a null source is a site of its own, a
    text of which all lines go is empty, a share of exactly the ratio stays, repeated rows are
    pages each, long texts are whole, other columns stay as they are."""
    cleaned = line_dedup(docs, host=F.col("source"))
    n_chars = F.when(F.col(f"`{cleaned.columns[-1]}`") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Documents without
    words are no duplicates of each other, rows without an id stay, and rows that share an id are
    one document, which stays or goes. A similarity of exactly NEAR_NUM / NEAR_DEN links; whole
    texts count, however long; columns stay as they are, whatever their names; an empty table gives
    an empty table."""
    classes = jaccard_classes(docs, n=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return anti_join(docs, "doc_id", save(gone, "near-duplicates"), "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark windows go; exactly a twentieth goes too.
    A text without words stays; repeated rows go or stay together; other cases are those of
    find_contamination()."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens: cases are those of pack(),
    by which a document without text is one token, and repeated rows are packed each."""
    return pack(docs, byte_bpe(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written before the next begins, and dropped
    when that one's are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
