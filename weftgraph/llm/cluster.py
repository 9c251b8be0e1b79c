"""What operators need of the cluster: their own code on every executor, a filter of bounded size
for large sets of ids, and column names that clash with none of a table's."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.shared import Scratch, save

__all__ = ["Scratch", "add_columns", "anti_join", "fold_ascii", "fresh", "keep_probable", "mark_probable", "named", "numbered", "save", "ship_code", "without"]

#: Rows of an Arrow batch. Spark's own number is 10,000, which is too much for long texts: a worker
#: and the JVM each hold a whole batch.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and have batches of texts be
    of moderate size, unless the session has its own number."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    name = "weftgraph_code.zip"
    if name in {os.path.basename(x) for x in spark.sparkContext._python_includes}:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="weftgraph-code-")) / name
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))
    assert SparkFiles.get(name)


def fold_ascii(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else changed."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores after those that df has columns of already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, **more: Column) -> DataFrame:
    """df with its columns named by place, c0, c1 and so on, and with `more` columns over df. No
    column that an operator adds for itself can clash with one of these."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *[e.alias(n) for n, e in more.items()])


def named(out: DataFrame, df: DataFrame, *more: str) -> DataFrame:
    """The columns of df by their own names, from rows that numbered(df) has led to, and `more`."""
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *more)


#: Bits of the largest id filter: its table has at most 2**17 rows of two longs.
FILTER_BITS = 1 << 23


def mark_probable(df: DataFrame, key: Column, members: DataFrame, member: Column, name: str) -> DataFrame:
    """df with a column `name` that says whether the key may be in `members`: true for every one
    that is, and for few others. A null key is in nothing, null members count for nothing.

    A one-hash Bloom filter made of built-in functions. Its table has FILTER_BITS / 64 rows
    whatever the number of members, so it can always be broadcast; with too many members it lets
    more rows through, never fewer.
    """
    slot = lambda c: F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)))
    at, word, bits = fresh(df, "_slot", "_word", "_bits")
    words = (
        members.select(slot(member).alias(at))
        .where(F.col(at).isNotNull())
        .groupBy(F.shiftright(at, 6).alias(word))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} % 64 as int))")).alias(bits))
    )
    probed = df.withColumn(at, slot(key)).withColumn(word, F.shiftright(at, 6))
    hit = F.expr(f"coalesce((shiftrightunsigned({bits}, cast({at} % 64 as int)) & 1L) = 1L, false)")
    joined = probed.join(F.broadcast(words), word, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name))


def keep_probable(df: DataFrame, key: Column, members: DataFrame, member: Column) -> DataFrame:
    """Rows of df whose key may be in `members`: every one that is, and few others."""
    (probable,) = fresh(df, "_probable")
    return mark_probable(df, key, members, member, probable).where(F.col(probable)).drop(probable)


def anti_join(df: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """Rows of df whose key is not among `members`, which has each once. Only rows that pass the
    filter of probable members are shuffled; the others go through as they are read."""
    probable, own = fresh(df, "_probable", "_member")
    marked = mark_probable(df, F.col(f"`{key}`"), members, F.col(member), probable)
    sure = marked.where(~F.col(probable)).drop(probable)
    rest = marked.where(F.col(probable)).drop(probable)
    return sure.unionByName(rest.join(members.select(F.col(member).alias(own)), F.col(f"`{key}`") == F.col(own), "left_anti"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names (as Spark compares them), which an operator is to set."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, make, fields: list, reads: list[str]) -> DataFrame:
    """df with more columns that `make` computes from whole Arrow batches.

    make(batches of the columns `reads`) yields for each batch the list of its new arrays. It runs
    once for each task, so that what it sets up first serves all batches.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_code(df.sparkSession)
    schema = StructType([*df.schema.fields, *fields])
    arrow = to_arrow_schema(StructType(fields))
    n = len(df.columns)
    at = [df.columns.index(x) for x in reads]

    def run(batches):
        seen = []

        def inputs():
            for b in batches:
                seen.append(b)
                yield [b.column(i) for i in at]

        for new in make(inputs()):
            b = seen.pop()
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(new, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema_names)

    schema_names = schema.names
    return df.mapInArrow(run, schema)
