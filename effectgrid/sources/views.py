"""Views on the star-schema test tables in the roles the analysis expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_COLUMNS = [
    "REACTOME_PRICE", "GOBP_DISCOUNT", "WP_TAX", "KEGG_UNIT_PRICE",
    "GOCC_ORDER_SHARE", "MOOTHA_MITOPHAGY",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect rows: one per order line."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    return (
        line.join(orders, "l_orderkey")
        .join(customer, "o_custkey")
        .select(
            F.col("l_partkey").cast("string").alias("gene"),
            F.concat_ws(".", "c_mktsegment", "l_returnflag").alias("celltype"),
            F.concat(F.lit("prio_"), F.substring("o_orderpriority", 1, 1), F.lit(".scaled")).alias("pathology"),
            F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("sex"),
            F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("logFC"),
            (F.col("l_quantity") / 50).alias("adj_p"),
        )
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item annotations: part brands."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("goall"), F.col("p_partkey").cast("string").alias("symbol")
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(child-parent edges, root terms, direct annotations): region > nation > nation/segment."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    region_term = F.concat(F.lit("R"), F.col("n_regionkey"))
    nation_term = F.concat(F.lit("N"), F.col("n_nationkey"))
    unit_term = F.concat(F.lit("N"), F.col("c_nationkey"), F.lit("/"), F.col("c_mktsegment"))
    edges = nation.select(nation_term.alias("child"), region_term.alias("parent")).union(
        customer.select(
            unit_term.alias("child"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("parent")
        ).distinct()
    )
    roots = table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("term")
    )
    direct = customer.select(unit_term.alias("term"), F.col("c_name").alias("symbol"))
    return edges, roots, direct


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide observation rows: one per order line, with donor phenotypes.

    Donor = customer; phenotypes = mean order price per priority, and balance.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    line = table(spark, sf_dir, "lineitem")
    donors = orders.groupBy("o_custkey").agg(
        *[
            F.avg(F.when(F.col("o_orderpriority").startswith(str(i)), F.col("o_totalprice"))).alias(f"prio_{i}")
            for i in range(1, 6)
        ]
    )
    donor_facts = customer.select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey",
        F.col("c_acctbal").alias("acctbal"),
    ).join(donors, "o_custkey")
    return (
        line.join(
            orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"),
            "l_orderkey",
        )
        .join(donor_facts, "o_custkey")
        .select(
            F.col("o_custkey").alias("projid"),
            F.col("c_nationkey").alias("site"),
            F.col("c_mktsegment").alias("major.celltype.0"),
            (F.col("c_nationkey") % 2).alias("msex"),
            F.col("l_quantity").alias("pct_counts_mt"),
            F.col("l_linenumber").alias("total_counts"),
            F.col("l_extendedprice").alias("REACTOME_PRICE"),
            F.col("l_discount").alias("GOBP_DISCOUNT"),
            F.col("l_tax").alias("WP_TAX"),
            F.try_divide("l_extendedprice", "l_quantity").alias("KEGG_UNIT_PRICE"),
            F.try_divide("l_extendedprice", "o_totalprice").alias("GOCC_ORDER_SHARE"),
            F.col("l_linenumber").alias("MOOTHA_MITOPHAGY"),
            *[f"prio_{i}" for i in range(1, 6)],
            "acctbal",
            "l_orderkey",
            "l_linenumber",
        )
    )


def revised_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in which the balance was revised at a seventh line of an order.

    Donors with such a line and others have two phenotype rows.
    """
    later = F.when(F.col("l_linenumber") == 7, 1.0).otherwise(0.0)
    return observations(spark, sf_dir).withColumn("acctbal", F.col("acctbal") + later)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form; entries of small size count as missing."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").cast("string").alias("item"), F.posexplode("embedding").alias("pos", "v"))
        .select(
            "item",
            F.col("pos").cast("string").alias("dim"),
            F.when(F.abs(F.col("v")) >= 0.03, F.col("v").cast("double")).alias("value"),
        )
    )
