"""Declared keys and relations of the sample tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from braidlake.sources.catalog import Catalog, Declared, ForeignKey

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")
DECLARED = {
    "region": Declared(key=("r_regionkey",)),
    "nation": Declared(key=("n_nationkey",), foreign_keys=(ForeignKey("n_regionkey", "region", "r_regionkey"),)),
    "customer": Declared(key=("c_custkey",), foreign_keys=(ForeignKey("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": Declared(key=("s_suppkey",), foreign_keys=(ForeignKey("s_nationkey", "nation", "n_nationkey"),)),
    "part": Declared(key=("p_partkey",)),
    "orders": Declared(key=("o_orderkey",), foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey"),), enums={"o_orderstatus": ("F", "O", "P")}),
    "lineitem": Declared(foreign_keys=(ForeignKey("l_orderkey", "orders", "o_orderkey", backward_name="lines"), ForeignKey("l_partkey", "part", "p_partkey"), ForeignKey("l_suppkey", "supplier", "s_suppkey"))),
    "events": Declared(key=("event_id",), foreign_keys=(ForeignKey("user_id", "customer", "c_custkey"),), scalars={"props": "JSON"}),
    "documents": Declared(key=("doc_id",), search=("text",)),
    "labels": Declared(key=("doc_id",), foreign_keys=(ForeignKey("doc_id", "documents", "doc_id", backward_single_name="label"),)),
    "benchmark": Declared(key=("item_id",)),
    "pages": Declared(key=("page_id",)),
    "conversations": Declared(key=("conv_id", "turn")),
    "embeddings": Declared(key=("vec_id",)),
}


def catalog(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> Catalog:
    return Catalog.from_path(spark, root, list(names), {n: DECLARED[n] for n in names})
