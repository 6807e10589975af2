"""The given star-schema tables as one graph of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

from tessella.operators.graph import LABEL
from tessella.plans.registry import table
from tessella.sources.readers import TripleTables, melt


def iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def shop_graph(spark: SparkSession, sf_dir: str) -> TripleTables:
    """Every table melted lazily; a question scans only the predicates it names."""
    t = lambda name: lambda: table(spark, sf_dir, name)
    day = F.to_date("o_orderdate")
    parts = [
        melt(t("region"), iri("region", "r_regionkey"), "Region", literals={LABEL: F.col("r_name")}),
        melt(
            t("nation"), iri("nation", "n_nationkey"), "Nation",
            {"inRegion": iri("region", "n_regionkey")}, {LABEL: F.col("n_name")},
        ),
        melt(
            t("customer"), iri("customer", "c_custkey"), "Customer",
            {"inNation": iri("nation", "c_nationkey")},
            {LABEL: F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": money("c_acctbal")},
        ),
        melt(
            t("supplier"), iri("supplier", "s_suppkey"), "Supplier",
            {"inNation": iri("nation", "s_nationkey")}, {LABEL: F.col("s_name"), "balance": money("s_acctbal")},
        ),
        melt(
            t("part"), iri("part", "p_partkey"), "Part", None,
            {LABEL: F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"), "size": F.col("p_size"), "price": money("p_retailprice")},
        ),
        melt(
            t("orders"), iri("order", "o_orderkey"), "Order",
            {"placedBy": iri("customer", "o_custkey")},
            {
                "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "total": money("o_totalprice"),
                "date": day, "year": F.year("o_orderdate"),
            },
        ),
        melt(
            t("lineitem"), iri("order", "l_orderkey"), None,
            {"hasPart": iri("part", "l_partkey"), "shippedBy": iri("supplier", "l_suppkey")},
            {"returnFlag": F.col("l_returnflag"), "lineStatus": F.col("l_linestatus"), "quantity": money("l_quantity")},
        ),
        melt(
            t("documents"), iri("document", "doc_id"), "Document", None,
            {"text": F.col("text"), "source": F.col("source")}, {"text": F.col("lang")},
        ),
        melt(t("labels"), iri("document", "doc_id"), None, None, {"quality": F.col("quality"), "toxic": F.col("toxic")}),
    ]
    return reduce(lambda a, b: a + b, parts)
