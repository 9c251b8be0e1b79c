"""A star schema of relational tables seen as a graph.

Vertices are keys: Region, Nation, Customer, Supplier, Part, Order and EventType, with the
super-label Party over customers and suppliers. Edges are foreign keys and what follows from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.catalog import EdgeStats, GraphCatalog
from weftgraph.sources.loader import catalog_from_tables, dense_ids
from weftgraph.sources.schema import EdgeTable, GraphSchema

_LEAVES = ["Customer", "EventType", "Nation", "Order", "Part", "Region", "Supplier"]
_EDGES = [
    ("IN_REGION", "Nation", "Region"),
    ("IN_NATION", "Customer", "Nation"),
    ("IN_NATION", "Supplier", "Nation"),
    ("PLACED", "Customer", "Order"),
    ("CONTAINS", "Order", "Part"),
    ("SUPPLIED_BY", "Order", "Supplier"),
    ("SUPPLIES", "Supplier", "Part"),
    ("HAS_INTEREST", "Customer", "EventType"),
    ("KNOWS", "Customer", "Customer"),
]

STAR_SCHEMA = GraphSchema({x: f"{x}.csv" for x in _LEAVES}, {"Party": ["Customer", "Supplier"]}, [EdgeTable(*e) for e in _EDGES], {"KNOWS"})

#: Events above this value show an interest.
INTEREST_OVER = 150.0


#: Buyers of a part that one task pairs with each other.
BUYERS = 4_096


def _pairs(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def co_purchases(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, most: int = BUYERS) -> DataFrame:
    """(src, dst), src < dst: customers who bought the same part from suppliers of one nation.

    Buyers are one row for each part, nation and customer before they are paired, so that a pair
    is made once for each purchase in common and not for each line. A part with more than `most`
    buyers is dealt to several tasks: its buyers have parts, which meet in pairs. The loader makes a
    set of the pairs and adds the other direction."""
    lines = lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    bought = (
        lines.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select("l_partkey", "s_nationkey", F.col("o_custkey").cast("long").alias("c"))
        .distinct()
    )
    keys = ["l_partkey", "s_nationkey"]
    hot = bought.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("parts"))
    dealt = bought.join(hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("c"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    one = dealt.select(*keys, own.alias("i"), every.alias("j"), F.col("c").alias("src"))
    other = dealt.select(*keys, every.alias("i"), own.alias("j"), F.col("c").alias("dst"))
    return one.join(other, [*keys, "i", "j"]).where("src < dst").select("src", "dst")


def star_graph(spark: SparkSession, folder: str, keep: bool = True) -> GraphCatalog:
    """The catalog over Parquet tables in `folder`. keep: hold edge sets once made, in memory or on
    disk, as patterns use them again; for a graph that is used for long, store it instead."""
    t = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    number = dense_ids(t["events"].select(F.col("event_type").alias("id"))).select(F.col("id").alias("event_type"), F.col("dense").alias("id"))
    vertices = {
        "Region": t["region"].select(F.col("r_regionkey").alias("id")),
        "Nation": t["nation"].select(F.col("n_nationkey").alias("id")),
        "Customer": t["customer"].select(F.col("c_custkey").alias("id")),
        "Supplier": t["supplier"].select(F.col("s_suppkey").alias("id")),
        "Part": t["part"].select(F.col("p_partkey").alias("id")),
        "Order": t["orders"].select(F.col("o_orderkey").alias("id")),
        "EventType": number.select("id"),
    }
    interest = t["events"].where(F.col("value") > INTEREST_OVER).select("user_id", "event_type").join(number, "event_type")
    tables = {
        ("IN_REGION", "Nation", "Region"): _pairs(t["nation"], "n_nationkey", "n_regionkey"),
        ("IN_NATION", "Customer", "Nation"): _pairs(t["customer"], "c_custkey", "c_nationkey"),
        ("IN_NATION", "Supplier", "Nation"): _pairs(t["supplier"], "s_suppkey", "s_nationkey"),
        ("PLACED", "Customer", "Order"): _pairs(t["orders"], "o_custkey", "o_orderkey"),
        ("CONTAINS", "Order", "Part"): _pairs(t["lineitem"], "l_orderkey", "l_partkey"),
        ("SUPPLIED_BY", "Order", "Supplier"): _pairs(t["lineitem"], "l_orderkey", "l_suppkey"),
        ("SUPPLIES", "Supplier", "Part"): _pairs(t["lineitem"], "l_suppkey", "l_partkey"),
        ("HAS_INTEREST", "Customer", "EventType"): _pairs(interest, "user_id", "id"),
        ("KNOWS", "Customer", "Customer"): co_purchases(t["lineitem"], t["orders"], t["supplier"]),
    }
    # Estimates from row counts, which Parquet files state.
    sizes = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, v in [*t.items(), ("types", number)]]
    n = {r.k: float(r.n) for r in reduce(DataFrame.unionByName, sizes).collect()}
    lines = n["lineitem"]
    stats = {
        ("IN_REGION", "Nation", "Region"): (n["nation"], n["nation"], n["region"]),
        ("IN_NATION", "Customer", "Nation"): (n["customer"], n["customer"], n["nation"]),
        ("IN_NATION", "Supplier", "Nation"): (n["supplier"], n["supplier"], n["nation"]),
        ("PLACED", "Customer", "Order"): (n["orders"], n["customer"], n["orders"]),
        ("CONTAINS", "Order", "Part"): (lines, n["orders"], n["part"]),
        ("SUPPLIED_BY", "Order", "Supplier"): (lines, n["orders"], n["supplier"]),
        ("SUPPLIES", "Supplier", "Part"): (lines, n["supplier"], n["part"]),
        ("HAS_INTEREST", "Customer", "EventType"): (min(n["events"], n["customer"] * max(1.0, n["types"])), n["customer"], n["types"]),
        ("KNOWS", "Customer", "Customer"): (50 * n["customer"], n["customer"], n["customer"]),
    }
    g = catalog_from_tables(spark, STAR_SCHEMA, vertices, tables, stats={k: EdgeStats(*map(int, v)) for k, v in stats.items()})
    return g.persist() if keep else g
