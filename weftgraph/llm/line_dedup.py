"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, fresh, named, numbered

#: A line on more than this share of a site's pages is boilerplate. On sites of 500 pages and more
#: lines have either 0.086 of the pages or more, as boilerplate repeated in the whole corpus has, or
#: 0.048 at most; this is between them.
RATIO = 0.065
#: A line repeats if so many pages of the site have it; what is on one page only is no boilerplate,
#: however few pages there are.
MIN_PAGES = 2
#: So many (site, line) pairs at most are broadcast, 16 bytes each; beyond that they are joined.
BROADCAST_LINES = 200_000
#: When the lines are joined, a site with more than one in so many of all pages is dealt to several
#: tasks. There are fewer such sites than this.
HOT_SITES = 4_096
#: ... if it has so many pages at least.
HOT_PAGES = 20_000

_BLANKS = " \t\r"


def line_keys(text: Column) -> Column:
    """A hash for each line, without blanks around it; null for a blank line."""
    bare = lambda x: F.btrim(x, F.lit(_BLANKS))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(bare(x) != "", F.xxhash64(bare(x))))


def boilerplate_lines(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(host, line): hashes of the lines on more than `ratio` of their host's pages; and (host,
    total): its number of pages."""
    pages = docs.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.array_distinct(line_keys(text)).alias("lines"))
    on_pages = (
        pages.select("host", F.explode("lines").alias("line"))
        .where("line is not null")
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    return on_pages.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "line"), totals


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row. A column that a lambda function uses is
    else computed again for each element, as the optimizer puts its expression into the lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_lines(rows: DataFrame, found: DataFrame, totals: DataFrame, spread: Column, broadcast_lines: int) -> DataFrame:
    """rows (with `host`) and a column `drop`: the boilerplate lines of the host, null if it has none."""
    per_host = found.groupBy("host").agg(F.collect_set("line").alias("drop"))
    if found.count() <= broadcast_lines:
        return rows.join(F.broadcast(per_host), "host", "left")
    # A site of very many pages goes to several tasks: its lines to each, a page to one of them.
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    share = max(HOT_PAGES, every // HOT_SITES + 1)
    hot = totals.where(F.col("total") > share).select("host", F.ceil(F.col("total") / share).cast("int").alias("parts"))
    parts = lambda df: df.join(F.broadcast(hot), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = parts(per_host).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return parts(rows).withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).drop("parts").join(dealt, ["host", "part"], "left").drop("part")


def line_dedup(
    docs: DataFrame,
    host: Column,
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    id_col: str = "doc_id",
) -> DataFrame:
    """Drop lines that are boilerplate of their site: those on more than `ratio` of all pages of
    the host, and on `min_pages` pages at least.

    Returns docs with all columns, the text without such lines, and _n_lines and _n_dropped. Lines
    are compared without blanks around them, by 64 bits of hash within a host; blank lines are
    kept. Counts are over all rows. A host has at most (mean lines per page) / ratio such lines, so
    its set fits in a row. id_col, if docs has it, deals a hot site's pages to tasks.

    Defined cases: a null text stays null and counts as a page with no lines; a null host is the
    host "". A page with a line twice counts once, and both go. A row that occurs twice is two
    pages. A page of which all lines go keeps its row, with an empty text. A share of exactly
    `ratio` stays. Very long texts and lines are read whole; a page's lines are looked up among
    the boilerplate on that page alone, in buckets. Columns of docs stay as they are, whatever
    their names; if docs has a column _n_lines or _n_dropped, the result's has one more underscore.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    places = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    text = places[text_col]
    rows = numbered(docs, host=F.coalesce(host.cast("string"), F.lit("")))
    found, totals = boilerplate_lines(rows, F.col("host"), text, ratio, min_pages)
    found = scratch.save(found, "boilerplate")
    spread = F.xxhash64(*[c for c in (places.get(id_col), text) if c is not None])
    joined = _with_lines(rows, found, totals, spread, broadcast_lines)
    # Lines are hashed only where their host has something to drop.
    marked = joined.withColumn("keys", F.when(F.col("drop").isNotNull(), line_keys(text)))
    marked = marked.withColumn("hits", F.when(F.arrays_overlap("keys", "drop"), F.array_intersect("keys", "drop")))
    lines = F.split(text, "\n")

    def without_hits(s: Column) -> Column:
        gone = lambda key: F.coalesce(F.array_contains(F.get(s["buckets"], F.pmod(key, F.size(s["buckets"])).cast("int")), key), F.lit(False))
        return F.filter(s["lines"], lambda x, i: ~gone(F.get(s["keys"], i)))

    def in_buckets(hits: Column) -> Column:
        return _let(F.greatest(F.sqrt(F.size(hits)).cast("int"), F.lit(1)), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(hits, lambda x: F.pmod(x, n) == b)))

    # Hits in about as many buckets as each has members, so that a line is held against few.
    parts = F.struct(lines.alias("lines"), F.col("keys"), _let(F.col("hits"), in_buckets).alias("buckets"))
    marked = marked.withColumn("kept", F.when(F.col("hits").isNotNull(), _let(parts, without_hits)))
    zero = F.lit(0).cast("long")
    marked = (
        marked.withColumn("n_lines", F.when(text.isNull(), zero).otherwise(F.coalesce(F.size(lines), F.lit(0)).cast("long")))
        .withColumn("n_dropped", F.when(F.col("kept").isNull(), zero).otherwise(F.col("n_lines") - F.size("kept")))
        .withColumn(f"c{docs.columns.index(text_col)}", F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n")))
    )
    n_lines, n_dropped = fresh(docs, "_n_lines", "_n_dropped")
    return named(marked, docs, F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped))
