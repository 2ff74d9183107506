"""A graph over the star-schema tables: what the graph operators run on in queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolary.sources.shared import enough_partitions
from symbolary.sources.tables import table


def _key(letter: str, column: str):
    return F.concat(F.lit(f"{letter}_"), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, label, kind, file, line: regions as files, nations as classes, customers and suppliers as functions, parts as methods."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of = lambda df, letter, key, label, kind, file: df.select(_key(letter, key).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), F.col(file).alias("file"), F.col(key).cast("int").alias("line"))
    home = nation.select("n_nationkey", "n_name")
    return (
        of(region, "r", "r_regionkey", "r_name", "file", "r_name")
        .unionByName(of(named, "n", "n_nationkey", "n_name", "class", "r_name"))
        .unionByName(of(table(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")), "c", "c_custkey", "c_name", "function", "n_name"))
        .unionByName(of(table(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")), "s", "s_suppkey", "s_name", "function", "n_name"))
        .unionByName(of(table(spark, d, "part"), "p", "p_partkey", "p_name", "method", "p_brand"))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, relation, resolved: containment by geography, calls from buyers and sellers to parts.

    A call is resolved if one of its lines has status F; else it leads to the part's ?name.
    """
    nation, line, part = table(spark, d, "nation"), table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name")
    enough_partitions(line, table(spark, d, "orders"))
    edge = lambda df, s, t: df.select(s.alias("source"), t.alias("target"), F.lit("contains").alias("relation"), F.lit(True).alias("resolved"))
    held = (
        edge(nation, _key("r", "n_regionkey"), _key("n", "n_nationkey"))
        .unionByName(edge(table(spark, d, "customer"), _key("n", "c_nationkey"), _key("c", "c_custkey")))
        .unionByName(edge(table(spark, d, "supplier"), _key("n", "s_nationkey"), _key("s", "s_suppkey")))
    )

    def calls(df: DataFrame, letter: str, key: str) -> DataFrame:
        # reduced to pairs before parts are joined
        pairs = df.groupBy(key, "l_partkey").agg(F.max(F.col("l_linestatus") == "F").alias("resolved"))
        named = pairs.join(part, F.col("l_partkey") == F.col("p_partkey"))
        target = F.when(F.col("resolved"), _key("p", "l_partkey")).otherwise(F.concat(F.lit("?"), F.col("p_name")))
        return named.select(_key(letter, key).alias("source"), target.alias("target"), F.lit("calls").alias("relation"), "resolved")

    bought = line.select("l_orderkey", "l_partkey", "l_linestatus").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return held.unionByName(calls(bought, "c", "o_custkey")).unionByName(calls(line, "s", "l_suppkey"))


NODES_SQL = """
nodes as (
  select 'r_' || r_regionkey as id, r_name as label, 'file' as kind, r_name as file, r_regionkey::integer as line from region
  union all select 'n_' || n_nationkey, n_name, 'class', r_name, n_nationkey::integer from nation join region on n_regionkey = r_regionkey
  union all select 'c_' || c_custkey, c_name, 'function', n_name, c_custkey::integer from customer join nation on c_nationkey = n_nationkey
  union all select 's_' || s_suppkey, s_name, 'function', n_name, s_suppkey::integer from supplier join nation on s_nationkey = n_nationkey
  union all select 'p_' || p_partkey, p_name, 'method', p_brand, p_partkey::integer from part)"""

EDGES_SQL = """
calls as (
  select 'c_' || o_custkey as source, l_partkey, bool_or(l_linestatus = 'F') as resolved from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey
  union all select 's_' || l_suppkey, l_partkey, bool_or(l_linestatus = 'F') from lineitem group by l_suppkey, l_partkey),
edges as (
  select 'r_' || n_regionkey as source, 'n_' || n_nationkey as target, 'contains' as relation, true as resolved from nation
  union all select 'n_' || c_nationkey, 'c_' || c_custkey, 'contains', true from customer
  union all select 'n_' || s_nationkey, 's_' || s_suppkey, 'contains', true from supplier
  union all select source, case when resolved then 'p_' || l_partkey else '?' || p_name end, 'calls', resolved from calls join part on l_partkey = p_partkey),
degree as (select id, count(*) as degree from (select source as id from edges where resolved union all select target from edges where resolved) group by id)"""

WITH = f"with {NODES_SQL},{EDGES_SQL}"
