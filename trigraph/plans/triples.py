"""The driver's tables as one graph, in SQL that Spark and the checking engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.graph import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "triples", "kv_records", "books", "people_raw")

EDGES = """
SELECT concat('customer:', c_custkey) AS s, 'in_nation' AS p, concat('nation:', c_nationkey) AS o FROM customer
UNION SELECT concat('supplier:', s_suppkey), 'in_nation', concat('nation:', s_nationkey) FROM supplier
UNION SELECT concat('nation:', n_nationkey), 'in_region', concat('region:', n_regionkey) FROM nation
UNION SELECT concat('customer:', c_custkey), 'segment', c_mktsegment FROM customer
UNION SELECT concat('order:', o_orderkey), 'placed_by', concat('customer:', o_custkey) FROM orders
UNION SELECT concat('order:', o_orderkey), 'status', o_orderstatus FROM orders
UNION SELECT concat('order:', l_orderkey), 'contains', concat('part:', l_partkey) FROM lineitem
UNION SELECT concat('order:', l_orderkey), 'supplied_by', concat('supplier:', l_suppkey) FROM lineitem
UNION SELECT concat('part:', p_partkey), 'brand', p_brand FROM part
UNION SELECT concat('part:', p_partkey), 'child_of', concat('part:', CAST(floor(p_partkey / 2) AS BIGINT)) FROM part WHERE p_partkey >= 2
UNION SELECT concat('user:', user_id), 'did', event_type FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    views = {}
    for name in TABLES:
        if f"FROM {name}" in text:
            views[name] = table(spark, sf_dir, name)
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **views)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the relational tables. A filter on ``p`` removes all other tables from the plan."""
    return _view(spark, sf_dir, EDGES)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; its vertices and predicates are made distinct by themselves, without making the edges distinct first."""
    every = _view(spark, sf_dir, EDGES.replace("UNION SELECT", "UNION ALL SELECT"))
    ends, kinds = every.select(F.explode(F.array("s", "o")).alias("id")).distinct(), every.select("p").distinct()
    return Graph.from_triples(edges(spark, sf_dir), ends, kinds, vectors(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the ``triples`` table: a set of (s, p, o), rows with null parts left out."""
    every = table(spark, sf_dir, "triples").select("s", "p", "o").dropna()
    return Graph.from_triples(every.distinct(), every.select(F.explode(F.array("s", "o")).alias("id")).distinct(), every.select("p").distinct())
