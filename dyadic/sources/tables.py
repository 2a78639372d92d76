"""The shared test tables and the two dyad views built from them.

D (dyads): lineitem x orders x customer x part, one row per line item with
    user = o_custkey, item = l_partkey, term = year(o_orderdate),
    target y = l_quantity / 10, categorical and real features.
E (events): events as (sid, cid, term, grade, hours) dyads.

Only the columns each view needs are read, so Parquet column pruning and
filter pushdown reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.functions.scalar import clip
from dyadic.guide import FeatureGuide

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Columns that identify a row of D (l_orderkey, l_linenumber is not unique).
ROW_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_shipdate")

# Term 0 of view E: a term is a day.
FIRST_TERM = "2023-12-31"

DYAD_GUIDE = FeatureGuide(
    target="y", ents=("uid", "iid"),
    cats=("c_mktsegment", "p_brand", "o_orderpriority", "l_returnflag"),
    reals=("l_discount", "l_tax", "p_retailprice", "c_acctbal"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dyads(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """View D.  ``how='left'`` keeps line items without customer / part
    attributes (JN-1 semantics)."""
    li = table(spark, sf_dir, "lineitem").select(
        *ROW_KEY, "l_discount", "l_tax", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    # attributes first: those of customers meet the orders, so that each line
    # item crosses the network once per key and customers never meet them
    oc = o.join(c, o.o_custkey == c.c_custkey, how)
    d = (li.join(p, li.l_partkey == p.p_partkey, how)
           .join(oc, li.l_orderkey == oc.o_orderkey, "inner"))
    return d.select(
        *ROW_KEY,
        F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("iid"),
        F.year("o_orderdate").cast("long").alias("term"), "o_orderdate",
        (F.col("l_quantity") / 10.0).alias("y"),
        "c_mktsegment", "p_brand", "o_orderpriority", "l_returnflag",
        "l_discount", "l_tax", "p_retailprice", "c_acctbal")


def events_dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View E: sid = user_id, cid = event_type, term = days since
    ``FIRST_TERM``, grade = value / 100 clipped to [0, 4],
    hours = 1 + event_id % 4."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id", F.col("user_id").alias("sid"), F.col("event_type").alias("cid"),
        F.datediff(F.to_date("ts"), F.lit(FIRST_TERM)).cast("long").alias("term"),
        clip(F.col("value") / 100.0, 0.0, 4.0).alias("grade"),
        (F.lit(1) + F.pmod("event_id", F.lit(4))).cast("double").alias("hours"))
