"""A query for each operator, on the sample tables, with the SQL that gives the same rows."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.engine import Engine, Options
from braidlake.functions import codec
from braidlake.gql.parser import parse
from braidlake.gql.validate import Limits, aliases, complexity, depth
from braidlake.operators import relations, search
from braidlake.operators.metadata import channel
from braidlake.plans.connection import Page
from braidlake.sources import samples
from braidlake.sources.catalog import Catalog, Declared, ForeignKey
from braidlake.streaming.changes import changes, parsed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(samples.catalog(spark, sf_dir, names or samples.TABLES), Options(timeout_s=None))


def add(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def derived(spark: SparkSession, sf_dir: str) -> Engine:
    """Tables with nulls, lists, versions and a junction, made of the sample tables."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    from pyspark.sql import Window

    sources = {
        "orders": lambda: read("orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')")).withColumn("o_tags", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN array() ELSE array(o_orderkey % 3, o_orderkey % 11) END")),
        "customer": lambda: read("customer"),
        "part": lambda: read("part"),
        "order_part": lambda: read("lineitem").select("l_orderkey", "l_partkey").distinct(),
        "state": lambda: read("events").select("user_id", "event_type", F.col("event_id").alias("valid_from"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("valid_to")),
    }
    declared = {
        "orders": Declared(key=("o_orderkey",), foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey"),)),
        "customer": Declared(key=("c_custkey",)),
        "part": Declared(key=("p_partkey",)),
        "order_part": Declared(foreign_keys=(ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"))),
        "state": Declared(key=("user_id",), foreign_keys=(ForeignKey("user_id", "customer", "c_custkey", backward_single_name="state"),), versions=("valid_from", "valid_to")),
    }
    return Engine(Catalog(spark, sources, declared), Options(timeout_s=None))


_NULLED = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority), CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN []::BIGINT[] ELSE [o_orderkey % 3, o_orderkey % 11] END AS o_tags FROM orders)"
_STATE = "(SELECT user_id, event_type, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events)"


# Filters

def _filter(name: str, entity: str, where: dict, select: list[str], condition: str, source: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = derived(spark, sf_dir) if source else engine(spark, sf_dir)
        c = e.connection(entity, where)
        return c.filtered().select(*(c.scope.col(x).alias(x) for x in select))

    add(name, f"SELECT {', '.join(select)} FROM {source or entity} t WHERE {condition}")(run)


_P = {"oOrderpriority": None}
_ORD = ["o_orderkey", "o_orderpriority"]
for _name, _ops, _sql in (
    ("filter_is_null", {"isNull": True}, "o_orderpriority IS NULL"),
    ("filter_is_not_null", {"isNull": False}, "o_orderpriority IS NOT NULL"),
    ("filter_equal", {"equalTo": "1-URGENT"}, "o_orderpriority = '1-URGENT'"),
    ("filter_not_equal", {"notEqualTo": "1-URGENT"}, "o_orderpriority <> '1-URGENT'"),
    ("filter_like", {"like": "%-_I%"}, "o_orderpriority LIKE '%-_I%'"),
    ("filter_not_like", {"notLike": "%-_I%"}, "o_orderpriority NOT LIKE '%-_I%'"),
    ("filter_ilike", {"likeInsensitive": "%hig_"}, "o_orderpriority ILIKE '%hig_'"),
    ("filter_not_ilike", {"notLikeInsensitive": "%hig_"}, "o_orderpriority NOT ILIKE '%hig_'"),
    ("filter_starts_with", {"startsWith": "2-"}, "starts_with(o_orderpriority, '2-')"),
    ("filter_not_starts_with", {"notStartsWith": "2-"}, "NOT starts_with(o_orderpriority, '2-')"),
    ("filter_starts_with_ci", {"startsWithInsensitive": "2-h"}, "starts_with(lower(o_orderpriority), '2-h')"),
    ("filter_not_starts_with_ci", {"notStartsWithInsensitive": "2-h"}, "NOT starts_with(lower(o_orderpriority), '2-h')"),
    ("filter_ends_with", {"endsWith": "GH"}, "ends_with(o_orderpriority, 'GH')"),
    ("filter_not_ends_with", {"notEndsWith": "GH"}, "NOT ends_with(o_orderpriority, 'GH')"),
    ("filter_ends_with_ci", {"endsWithInsensitive": "gh"}, "ends_with(lower(o_orderpriority), 'gh')"),
    ("filter_not_ends_with_ci", {"notEndsWithInsensitive": "gh"}, "NOT ends_with(lower(o_orderpriority), 'gh')"),
    ("filter_includes", {"includes": "ED"}, "contains(o_orderpriority, 'ED')"),
    ("filter_not_includes", {"notIncludes": "ED"}, "NOT contains(o_orderpriority, 'ED')"),
    ("filter_includes_ci", {"includesInsensitive": "ed"}, "contains(lower(o_orderpriority), 'ed')"),
    ("filter_not_includes_ci", {"notIncludesInsensitive": "ed"}, "NOT contains(lower(o_orderpriority), 'ed')"),
    ("filter_equal_ci", {"equalToInsensitive": "2-high"}, "lower(o_orderpriority) = '2-high'"),
    ("filter_not_equal_ci", {"notEqualToInsensitive": "2-high"}, "lower(o_orderpriority) <> '2-high'"),
    ("filter_distinct_from_ci", {"distinctFromInsensitive": "2-high"}, "lower(o_orderpriority) IS DISTINCT FROM '2-high'"),
    ("filter_not_distinct_from_ci", {"notDistinctFromInsensitive": "2-high"}, "lower(o_orderpriority) IS NOT DISTINCT FROM '2-high'"),
    ("filter_range_ci", {"greaterThanInsensitive": "1-urgent", "lessThanOrEqualToInsensitive": "3-medium"}, "lower(o_orderpriority) > '1-urgent' AND lower(o_orderpriority) <= '3-medium'"),
    ("filter_range_ci_2", {"greaterThanOrEqualToInsensitive": "2-HIGH", "lessThanInsensitive": "4-NOT"}, "lower(o_orderpriority) >= '2-high' AND lower(o_orderpriority) < '4-not'"),
    ("filter_in_ci", {"inInsensitive": ["2-high", "1-Urgent"]}, "lower(o_orderpriority) IN ('2-high', '1-urgent')"),
    ("filter_not_in_ci", {"notInInsensitive": ["2-high"]}, "lower(o_orderpriority) NOT IN ('2-high')"),
    ("filter_distinct_from", {"distinctFrom": "2-HIGH"}, "o_orderpriority IS DISTINCT FROM '2-HIGH'"),
    ("filter_not_distinct_from", {"notDistinctFrom": "2-HIGH"}, "o_orderpriority IS NOT DISTINCT FROM '2-HIGH'"),
    ("filter_in", {"in": ["2-HIGH", "3-MEDIUM"]}, "o_orderpriority IN ('2-HIGH', '3-MEDIUM')"),
    ("filter_in_empty", {"in": []}, "false"),
    ("filter_not_in", {"notIn": ["2-HIGH", "3-MEDIUM"]}, "o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')"),
):
    _filter(_name, "orders", {"oOrderpriority": _ops}, _ORD, _sql, _NULLED)
_filter("filter_range", "orders", {"oTotalprice": {"greaterThan": 100000, "lessThanOrEqualTo": 200000}, "oOrderdate": {"greaterThanOrEqualTo": "1995-01-01", "lessThan": "1997-06-01T00:00:00"}}, ["o_orderkey", "o_totalprice"], "o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-06-01'")
_filter("filter_and", "orders", {"and": [{"oOrderstatus": {"equalTo": "F"}}, {"oTotalprice": {"lessThan": 90000}}, {}]}, ["o_orderkey"], "o_orderstatus = 'F' AND o_totalprice < 90000")
_filter("filter_or", "orders", {"or": [{"oOrderstatus": {"equalTo": "P"}}, {"oTotalprice": {"lessThan": 50000}, "oOrderkey": {"lessThan": 5000}}]}, ["o_orderkey"], "o_orderstatus = 'P' OR (o_totalprice < 50000 AND o_orderkey < 5000)")
_filter("filter_not", "orders", {"not": {"oOrderstatus": {"equalTo": "F"}, "oTotalprice": {"greaterThan": 90000}}}, ["o_orderkey"], "NOT (o_orderstatus = 'F' AND o_totalprice > 90000)")
_filter("filter_enum", "orders", {"oOrderstatus": {"in": ["F", "P"]}}, ["o_orderkey"], "o_orderstatus IN ('F', 'P')")
_filter("filter_array_some", "orders", {"oTags": {"some": {"greaterThan": 8}}}, ["o_orderkey"], "len(list_filter(o_tags, lambda x: x > 8)) > 0", _NULLED)
_filter("filter_array_none", "orders", {"oTags": {"none": {"equalTo": 1}}}, ["o_orderkey"], "len(list_filter(o_tags, lambda x: x = 1)) = 0", _NULLED)
_filter("filter_array_every", "orders", {"oTags": {"every": {"lessThan": 5}}}, ["o_orderkey"], "len(list_filter(o_tags, lambda x: NOT x < 5)) = 0", _NULLED)
_filter("filter_array_empty", "orders", {"oTags": {"isEmpty": True}}, ["o_orderkey"], "len(o_tags) = 0", _NULLED)

# Relation predicates
_filter("rel_filter_forward", "orders", {"customerByOCustkey": {"cMktsegment": {"equalTo": "BUILDING"}, "nationByCNationkey": {"nName": {"greaterThan": "NATION_1"}}}}, ["o_orderkey"], "EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n_name > 'NATION_1'))")
_filter("rel_exists", "orders", {"customerByOCustkeyExists": True, "linesExists": True}, ["o_orderkey"], "o_custkey IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey)")
_filter("rel_some", "customer", {"ordersByOCustkey": {"some": {"oTotalprice": {"greaterThan": 300000}}}}, ["c_custkey"], "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_filter("rel_none", "customer", {"ordersByOCustkey": {"none": {"oTotalprice": {"greaterThan": 300000}}}}, ["c_custkey"], "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_filter("rel_every", "customer", {"ordersByOCustkey": {"every": {"oTotalprice": {"lessThan": 350000}}}}, ["c_custkey"], "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < 350000)")
_filter("rel_every_nulls", "customer", {"ordersByOCustkey": {"every": {"oOrderpriority": {"lessThan": "4"}}}}, ["c_custkey"], f"NOT EXISTS (SELECT 1 FROM {_NULLED} WHERE o_custkey = c_custkey AND NOT o_orderpriority < '4')", "customer")
_filter("rel_or", "customer", {"or": [{"ordersByOCustkey": {"some": {"oTotalprice": {"greaterThan": 400000}}}}, {"cAcctbal": {"lessThan": 0}}]}, ["c_custkey"], "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR c_acctbal < 0")
_filter("rel_empty_in", "customer", {"ordersByOCustkey": {"none": {"oOrderkey": {"in": []}}}}, ["c_custkey"], "true")
_filter("rel_m2m_filter", "part", {"orders": {"some": {"oTotalprice": {"greaterThan": 400000}}}}, ["p_partkey"], "EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_totalprice > 400000)", "part")


# Projection, order and pages

def _page(name: str, entity: str, select: list[str], sql: str, nulled: bool = False, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = derived(spark, sf_dir) if nulled else engine(spark, sf_dir)
        df, _ = e.connection(entity, select=select, **request).rows()
        return df.select(*select)

    add(name, sql)(run)


def _cursor(**values) -> str:
    return base64.b64encode(json.dumps(values).encode()).decode()


_page("select_columns", "customer", ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
_page("order_by", "orders", ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", order=["O_TOTALPRICE_DESC"], first=25)
_page("order_by_multi", "orders", ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 40", order=["O_ORDERPRIORITY_ASC", "O_TOTALPRICE_DESC"], first=40)
_page("order_natural", "orders", ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", order=["NATURAL"], first=10)
_page("order_by_nulls", "orders", ["o_orderkey", "o_orderpriority"], f"SELECT o_orderkey, o_orderpriority FROM {_NULLED} ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey OFFSET 20 LIMIT 30", nulled=True, order=["O_ORDERPRIORITY_DESC"], nulls="NULLS_LAST", first=30, offset=20)
_page("order_nulls_default", "orders", ["o_orderkey", "o_orderpriority"], f"SELECT o_orderkey, o_orderpriority FROM {_NULLED} ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 30", nulled=True, order=["O_ORDERPRIORITY_DESC"], first=30)
_page("order_by_related", "orders", ["o_orderkey"], "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal DESC, o_orderkey LIMIT 30", order=["CUSTOMER_BY_O_CUSTKEY__C_ACCTBAL_DESC"], first=30)
_page("order_by_child_count", "customer", ["c_custkey"], "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 20", order=["ORDERS_BY_O_CUSTKEY_COUNT_DESC"], first=20)
_page("order_by_child_agg", "customer", ["c_custkey"], "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY n ASC NULLS LAST, c_custkey LIMIT 20", order=["ORDERS_BY_O_CUSTKEY_MAX_O_TOTALPRICE_ASC"], first=20)
_page("page_first", "events", ["event_id", "event_type"], "SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 15", where={"eventType": {"equalTo": "click"}}, order=["VALUE_DESC"], first=15)
_page("page_last", "events", ["event_id"], "SELECT event_id FROM events ORDER BY value ASC, event_id DESC LIMIT 15", order=["VALUE_DESC"], last=15)
_page("page_offset", "orders", ["o_orderkey"], "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 35", order=["O_TOTALPRICE_ASC"], first=10, offset=35)
_page("page_after", "customer", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_nationkey < 12 OR (c_nationkey = 12 AND c_custkey > 300) ORDER BY c_nationkey DESC, c_custkey LIMIT 20", order=["C_NATIONKEY_DESC"], first=20, after=_cursor(c_nationkey=12, c_custkey=300))
_page("page_before", "customer", ["c_custkey"], "SELECT c_custkey FROM customer WHERE c_nationkey > 12 OR (c_nationkey = 12 AND c_custkey < 300) ORDER BY c_nationkey, c_custkey DESC LIMIT 20", order=["C_NATIONKEY_DESC"], last=20, before=_cursor(c_nationkey=12, c_custkey=300))
_page("page_after_null", "orders", ["o_orderkey"], f"SELECT o_orderkey FROM {_NULLED} WHERE (o_orderpriority IS NULL AND o_orderkey > 100) OR o_orderpriority IS NOT NULL ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 50", nulled=True, order=["O_ORDERPRIORITY_DESC"], first=50, after=_cursor(o_orderpriority=None, o_orderkey=100))
_page("distinct_on", "orders", ["o_custkey", "o_orderkey"], "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_custkey LIMIT 60", order=["O_TOTALPRICE_DESC"], distinct=["O_CUSTKEY"], first=60)
_page("distinct_nulls", "orders", ["o_orderpriority", "o_orderkey"], f"SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {_NULLED}) WHERE r = 1", nulled=True, order=["O_TOTALPRICE_DESC"], distinct=["O_ORDERPRIORITY"])


@add("page_info", "SELECT true AS has_next, true AS has_previous, (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 5) AS start_key, (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 14) AS end_key")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir, "customer", "nation").connection("customer", first=10, offset=5).fetch().page_info()
    key = lambda c: json.loads(base64.b64decode(got[c]))["c_custkey"]
    return spark.createDataFrame([(got["hasNextPage"], got["hasPreviousPage"], key("startCursor"), key("endCursor"))], "has_next boolean, has_previous boolean, start_key long, end_key long")


@add("total_count", "SELECT count(*) AS total_count FROM orders WHERE o_orderstatus = 'F'")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).connection("orders", {"oOrderstatus": {"equalTo": "F"}}, first=3, distinct=["O_CUSTKEY"]).total()


@add("node_id", "SELECT c_custkey, base64(encode('[\"customer\",' || c_custkey || ']')) AS node_id FROM customer ORDER BY c_custkey LIMIT 100")
def node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = engine(spark, sf_dir, "customer").graphql("{ customers(first: 100) { nodes { cCustkey nodeId } } }")["data"]["customers"]["nodes"]
    return spark.createDataFrame([(int(n["cCustkey"]), n["nodeId"]) for n in nodes], "c_custkey long, node_id string")


@add("edge_cursor", "SELECT o_orderkey, base64(encode('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || '}')) AS edge_cursor FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20")
def edge_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).connection("orders", order=["O_CUSTKEY_ASC"], select=["o_orderkey"], first=20).fetch()
    return spark.createDataFrame([(r["o_orderkey"], got.cursor(r)) for r in got.rows], "o_orderkey long, edge_cursor string")


# Lookups and traversal

@add("single", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir, "orders").graphql('{ order(oOrderkey: "42") { oOrderkey oTotalprice } }')["data"]["order"]
    return spark.createDataFrame([(int(got["oOrderkey"]), got["oTotalprice"])] if got else [], "o_orderkey long, o_totalprice double")


@add("node", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 3")
def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", "region")
    got = e.graphql(f'{{ node(nodeId: "{codec.node_id("nation", [3])}") {{ ... on Nation {{ nNationkey nName regionByNRegionkey {{ rName }} }} }} }}')["data"]["node"]
    return spark.createDataFrame([(got["nNationkey"], got["nName"], got["regionByNRegionkey"]["rName"])], "n_nationkey int, n_name string, r_name string")


@add("by_node_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def by_node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = base64.b64encode(b'["customer",7]').decode()
    got = engine(spark, sf_dir, "customer").graphql(f'{{ customerByNodeId(nodeId: "{text}") {{ cCustkey cName }} }}')["data"]["customerByNodeId"]
    return spark.createDataFrame([(int(got["cCustkey"]), got["cName"])], "c_custkey long, c_name string")


@add("rel_forward", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def rel_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = engine(spark, sf_dir).scope("orders")
    joined = relations.with_parent(scope.frame(), scope, scope.entity.relations["customerByOCustkey"], {"c_name": "c_name"})
    return joined.select("o_orderkey", "c_name")


@add("rel_backward_single", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def rel_backward_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = engine(spark, sf_dir).scope("documents")
    joined = relations.with_parent(scope.frame(), scope, scope.entity.relations["label"], {"quality": "quality", "toxic": "toxic"})
    return joined.select(scope.col("doc_id"), "quality", "toxic")


@add("rel_backward", "SELECT c_custkey, o_orderkey, rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderstatus <> 'P') WHERE rank <= 3")
def rel_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    c = e.connection("customer", {"cAcctbal": {"greaterThan": 5000}})
    keys = c.filtered().select(c.scope.col("c_custkey"))
    df, _, _ = relations.children(c.scope, c.scope.entity.relations["ordersByOCustkey"], keys, {"oOrderstatus": {"notEqualTo": "P"}}, ["O_TOTALPRICE_DESC"], page=Page(first=3), select=["o_orderkey"])
    return df.select(F.col(relations.PARENT).alias("c_custkey"), "o_orderkey", F.col("__rank").cast("long").alias("rank"))


@add("rel_backward_count", "SELECT o_custkey AS c_custkey, count(*) AS total_count FROM orders WHERE o_totalprice > 200000 GROUP BY 1")
def rel_backward_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = engine(spark, sf_dir).scope("customer")
    got = relations.counts(scope, scope.entity.relations["ordersByOCustkey"], scope.frame().select("c_custkey"), {"oTotalprice": {"greaterThan": 200000}})
    return got.select(F.col(relations.PARENT).alias("c_custkey"), "total_count")


@add("rel_backward_agg", "SELECT o_custkey AS c_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def rel_backward_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = engine(spark, sf_dir).scope("customer")
    got, _ = relations.child_aggregates(scope, scope.entity.relations["ordersByOCustkey"], scope.frame().select("c_custkey"), {"count": [], "max": ["oTotalprice"]})
    return got.select(F.col(relations.PARENT).alias("c_custkey"), F.col("count").alias("n"), F.col("max_o_totalprice").alias("most"))


@add("rel_m2m", "SELECT o_orderkey, p_partkey, rank FROM (SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))) WHERE rank <= 2")
def rel_m2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_parts(derived(spark, sf_dir).connection("orders"))


def _first_parts(c) -> DataFrame:
    df, _, _ = relations.children(c.scope, c.scope.entity.relations["parts"], c.filtered().select("o_orderkey"), page=Page(first=2), select=["p_partkey"])
    return df.select(F.col(relations.PARENT).alias("o_orderkey"), "p_partkey", F.col("__rank").cast("long").alias("rank"))


@add("rel_nested", "SELECT c_custkey, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def rel_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _large_lines(engine(spark, sf_dir).connection("customer"))


def _large_lines(c) -> DataFrame:
    orders, _, second = relations.children(c.scope, c.scope.entity.relations["ordersByOCustkey"], c.filtered().select("c_custkey"), select=["o_orderkey"], limit=None)
    lines, _, _ = relations.children(second, second.entity.relations["lines"], orders.select("o_orderkey"), {"lQuantity": {"greaterThan": 45}}, select=["l_linenumber", "l_quantity"], limit=None)
    lines = lines.select(F.col(relations.PARENT).alias("order"), "l_linenumber", "l_quantity")
    return orders.join(lines, F.col("o_orderkey") == F.col("order")).select(F.col(relations.PARENT).alias("c_custkey"), "o_orderkey", "l_linenumber", "l_quantity")


# Aggregates

def _agg(name: str, wanted: dict[str, list[str]], columns: str, where: dict | None = None, condition: str = "true", round_to: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir).connection("orders", where).aggregates(wanted)
        return out if round_to is None else out.select(*(F.round(c, round_to).alias(c) for c in out.columns))

    add(name, f"SELECT {columns} FROM orders WHERE {condition}")(run)


_LARGE = {"oTotalprice": {"greaterThan": 150000}}
_agg("agg_count", {"count": []}, "count(*) AS count", _LARGE, "o_totalprice > 150000")
_agg("agg_distinct_count", {"distinctCount": ["oCustkey", "oOrderpriority"]}, "count(DISTINCT o_custkey) AS \"distinctCount_o_custkey\", count(DISTINCT o_orderpriority) AS \"distinctCount_o_orderpriority\"", _LARGE, "o_totalprice > 150000")
_agg("agg_sum", {"sum": ["oTotalprice"]}, "round(sum(o_totalprice), 2) AS sum_o_totalprice", round_to=2)
_agg("agg_avg", {"average": ["oTotalprice"]}, "round(avg(o_totalprice), 4) AS average_o_totalprice", round_to=4)
_agg("agg_stddev", {"stddevSample": ["oTotalprice"], "stddevPopulation": ["oTotalprice"]}, "round(stddev_samp(o_totalprice), 3) AS \"stddevSample_o_totalprice\", round(stddev_pop(o_totalprice), 3) AS \"stddevPopulation_o_totalprice\"", round_to=3)
@add("agg_variance", "SELECT round(var_samp(l_quantity), 6) AS sample_quantity, round(var_pop(l_quantity), 6) AS population_quantity, round(var_samp(l_discount), 10) AS sample_discount, round(var_pop(l_discount), 10) AS population_discount FROM lineitem")
def agg_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).connection("lineitem").aggregates({"varianceSample": ["lQuantity", "lDiscount"], "variancePopulation": ["lQuantity", "lDiscount"]})
    places = {"quantity": 6, "discount": 10}
    return got.select(*(F.round(f"variance{kind.title()}_l_{c}", n).alias(f"{kind}_{c}") for kind in ("sample", "population") for c, n in places.items()))


_agg("agg_min_max", {"min": ["oTotalprice", "oOrderkey"], "max": ["oTotalprice", "oOrderkey"]}, "min(o_totalprice) AS min_o_totalprice, min(o_orderkey) AS min_o_orderkey, max(o_totalprice) AS max_o_totalprice, max(o_orderkey) AS max_o_orderkey", _LARGE, "o_totalprice > 150000")


@add("grouped_agg", "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, max(l_tax) AS max_l_tax FROM lineitem GROUP BY 1, 2")
def grouped_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).connection("lineitem").grouped(["L_RETURNFLAG", "L_LINESTATUS"], {"count": [], "sum": ["lQuantity"], "max": ["lTax"]})
    return got.withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@add("grouped_agg_empty", "SELECT count(*) AS count, min(l_quantity) AS min_l_quantity FROM lineitem")
def grouped_agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).connection("lineitem").grouped([], {"count": [], "min": ["lQuantity"]})


for _unit in ("hour", "day"):
    add(f"grouped_agg_{_unit}", f"SELECT date_trunc('{_unit}', ts)::TIMESTAMP AS ts_{_unit}, event_type, count(*) AS count FROM events GROUP BY 1, 2")(
        lambda spark, sf_dir, unit=_unit: engine(spark, sf_dir).connection("events").grouped([f"TS_TRUNCATED_TO_{unit.upper()}", "EVENT_TYPE"], {"count": []})
    )


# History, search, changes and metadata

@add("as_of", f"SELECT user_id, event_type FROM {_STATE} WHERE valid_from <= 5000 AND (valid_to IS NULL OR 5000 < valid_to)")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).connection("state", point=5000).filtered().select("user_id", "event_type")


@add("as_of_latest", f"SELECT user_id, event_type FROM {_STATE} WHERE valid_to IS NULL")
def as_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).connection("state").filtered().select("user_id", "event_type")


@add("as_of_nested", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_STATE} WHERE user_id = c_custkey AND event_type = 'click' AND valid_from <= 5000 AND (valid_to IS NULL OR 5000 < valid_to))")
def as_of_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).connection("customer", {"state": {"eventType": {"equalTo": "click"}}}, point=5000).filtered().select("c_custkey")


_WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+')"


@add("search", f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: w IN ('the', 'idiot'))) AS score FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'idiot')")
def search_(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = engine(spark, sf_dir, "documents").scope("documents")
    return search.search(scope, " The idiot! ").select("doc_id", F.col("__score").cast("long").alias("score"))


_KIND = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


@add("change_filter", f"SELECT event_id::VARCHAR AS id, {_KIND} AS mutation_type FROM events WHERE {_KIND} IN ('INSERT', 'DELETE')")
def change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.expr(_KIND).alias("mutation_type"))
    return changes(feed, kinds=["INSERT", "DELETE"])


@add("change_enriched", f"SELECT c.c_custkey::VARCHAR AS id, c.c_name FROM customer c WHERE c.c_custkey IN (SELECT user_id FROM events WHERE {_KIND} <> 'DELETE')")
def change_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet"))


def _enriched(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    feed = events.select(F.col("user_id").cast("string").alias("id"), F.expr(_KIND).alias("mutation_type"))
    got = engine(spark, sf_dir, "customer").changes(feed, "customer")
    return got.where("_entity IS NOT NULL").select("id", F.get_json_object("_entity", "$.c_name").alias("c_name")).distinct()


@add("metadata", "SELECT 'chain' AS field, 'main' AS value UNION ALL SELECT 'lastProcessedHeight', max(event_id)::VARCHAR FROM events UNION ALL SELECT 'rows of ' || name, n::VARCHAR FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'nation', count(*) FROM nation)")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    table = lambda: read("events").select(F.lit("lastProcessedHeight").alias("key"), F.max("event_id").cast("string").alias("value")).unionByName(spark.createDataFrame([("chain", '"main"')], "key string, value string"))
    names = ("customer", "nation", "events")
    e = Engine(Catalog(spark, {n: (lambda n=n: read(n)) for n in names}, {}, {"_metadata": table}), Options(timeout_s=None))
    got = e.graphql("{ _metadata { chain lastProcessedHeight rowCountEstimate { table estimate } } }")["data"]["_metadata"]
    rows = [(k, str(got[k])) for k in ("chain", "lastProcessedHeight")] + [(f"rows of {r['table']}", str(r["estimate"])) for r in got["rowCountEstimate"]]
    return spark.createDataFrame(rows, "field string, value string")


@add("metadatas", "SELECT 'a' AS chain, count(*)::VARCHAR AS height FROM events UNION ALL SELECT 'b', count(*)::VARCHAR FROM orders")
def metadatas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(chain: str, name: str):
        counted = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count(F.lit(1)).cast("string").alias("value"))
        return counted.select(F.lit("lastProcessedHeight").alias("key"), "value").unionByName(spark.createDataFrame([("chain", f'"{chain}"')], "key string, value string"))

    tables = {"_metadata_a": lambda: table("a", "events"), "_metadata_b": lambda: table("b", "orders")}
    e = Engine(Catalog(spark, {"nation": lambda: spark.read.parquet(f"{sf_dir}/nation.parquet")}, {}, tables), Options(timeout_s=None))
    got = e.graphql("{ _metadatas { nodes { chain lastProcessedHeight } } }")["data"]["_metadatas"]["nodes"]
    return spark.createDataFrame([(n["chain"], str(n["lastProcessedHeight"])) for n in got], "chain string, height string")


@add("change_ids", f"SELECT event_id::VARCHAR AS id, {_KIND} AS mutation_type FROM events WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey IN (5, 6, 7, 8, 9))")
def change_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.expr(_KIND).alias("mutation_type"))
    return changes(feed, ids=["5", "6", "7", "8", "9"])


@add("subscription", f"SELECT c.c_custkey::VARCHAR AS id, c.c_name, count(*) AS n FROM customer c JOIN events ON user_id = c_custkey WHERE {_KIND} = 'INSERT' GROUP BY 1, 2")
def subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.expr(_KIND).alias("mutation_type"))
    got = engine(spark, sf_dir, "customer").subscribe("subscription { customers(mutation: [INSERT]) { id mutation_type _entity { cName } } }", {"customer": feed})
    at = lambda path: F.get_json_object("payload", f"$.data.customers.{path}")
    return got.where(at("_entity").isNotNull()).select(at("id").alias("id"), at("_entity.cName").alias("c_name")).groupBy("id", "c_name").agg(F.count(F.lit(1)).alias("n"))


# Views and searches of one's own

@add("view", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").createOrReplaceTempView("filled_orders")
    c = Catalog.from_database(spark, "default", {"filled_orders": Declared(key=("o_orderkey",))})
    return Engine(c, Options(timeout_s=None)).connection("filled_orders", {"oTotalprice": {"greaterThan": 100000}}).filtered().select("o_orderkey", "o_totalprice")


@add("search_function", "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%1%'")
def search_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda rows, query: rows.where(F.col("n_name").contains(query))
    e = Engine(Catalog(spark, {"nation": lambda: spark.read.parquet(f"{sf_dir}/nation.parquet")}, {"nation": Declared(key=("n_nationkey",), finder=found)}), Options(timeout_s=None))
    got = e.graphql('{ search_nation(search: "1", first: 100) { nodes { nNationkey nName } } }')["data"]["search_nation"]["nodes"]
    return spark.createDataFrame([(n["nNationkey"], n["nName"]) for n in got], "n_nationkey int, n_name string")


# Typed filters

def _typed(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations with a JSON, an interval and a point column made of their keys."""
    read = lambda: spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey",
        F.concat(F.lit('{ "b": [1, 2.50],  "a": '), F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.col("n_regionkey").cast("string"), F.lit(".0"))).otherwise(F.col("n_regionkey").cast("string")), F.lit(" }")).alias("n_json"),
        F.when(F.col("n_nationkey") % 5 > 0, F.struct(F.col("n_regionkey").alias("years"), (F.col("n_nationkey") % 5).cast("int").alias("months"))).alias("n_interval"),
        F.struct((F.col("n_regionkey") / 2).alias("x"), F.col("n_nationkey").cast("double").alias("y")).alias("n_point"))
    return Engine(Catalog(spark, {"nation": read}, {"nation": Declared(key=("n_nationkey",), scalars={"n_json": "JSON", "n_interval": "Interval", "n_point": "Point"})}), Options(timeout_s=None))


def _typed_filter(name: str, where: dict, condition: str) -> None:
    add(name, f"SELECT n_nationkey FROM nation WHERE {condition}")(lambda spark, sf_dir: _typed(spark, sf_dir).connection("nation", where).filtered().select("n_nationkey"))


_typed_filter("filter_json", {"or": [{"nJson": {"equalTo": {"a": 2, "b": [1.0, 2.5]}}}, {"nJson": {"equalTo": '{"a":3.0,"b":[1,2.5]}'}}]}, "n_regionkey IN (2, 3)")
_typed_filter("filter_json_distinct", {"nJson": {"distinctFrom": {"b": [1, 2.5], "a": 0}}}, "n_regionkey <> 0")
_typed_filter("filter_interval", {"nInterval": {"equalTo": {"months": 2, "years": 2}}}, "n_regionkey = 2 AND n_nationkey % 5 = 2")
_typed_filter("filter_interval_null", {"or": [{"nInterval": {"isNull": True}}, {"nInterval": {"notDistinctFrom": {"years": 3, "months": 3, "days": 0}}}]}, "n_nationkey % 5 = 0 OR (n_regionkey = 3 AND n_nationkey % 5 = 3)")
_typed_filter("filter_point", {"or": [{"nPoint": {"equalTo": {"x": 1, "y": 2}}}, {"nPoint": {"startsWith": "(0.5,1"}}, {"nPoint": {"in": ["(1.5,3)", "(2, 4)"]}}]}, "(n_regionkey = 2 AND n_nationkey = 2) OR (n_regionkey = 1 AND n_nationkey::VARCHAR LIKE '1%') OR (n_regionkey = 3 AND n_nationkey = 3) OR (n_regionkey = 4 AND n_nationkey = 4)")


# Catalog and API

_TABLES = ", ".join(f"'{t}'" for t in samples.TABLES)
_CAMEL = "array_to_string(list_transform(string_split(column_name, '_'), lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(w[1]) || w[2:] END), '')"
_SCALAR = "CASE WHEN column_name = 'props' THEN 'JSON' WHEN data_type = 'BIGINT' THEN 'BigInt' WHEN data_type = 'INTEGER' THEN 'Int' WHEN data_type = 'DOUBLE' THEN 'Float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'Datetime' WHEN data_type LIKE '%[]' THEN 'List' ELSE 'String' END"


@add("catalog_columns", f"SELECT table_name, column_name, ordinal_position::INT AS place, {_CAMEL} AS field, CASE WHEN column_name = 'o_orderstatus' THEN 'Enum' ELSE {_SCALAR} END AS scalar FROM information_schema.columns WHERE table_name IN ({_TABLES})")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Catalog.from_path(spark, sf_dir, None, samples.DECLARED).entities
    rows = [(n, c, i + 1, f, e.scalar(c)) for n, e in found.items() if n in samples.TABLES for i, (f, c) in enumerate(e.fields.items())]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int, field string, scalar string")


@add("catalog_keys", " UNION ALL ".join(f"SELECT '{t}.{k.column}' AS key_column, '{k.table}' AS parent, count(*) AS rows_with_parent FROM {t} WHERE {k.column} IN (SELECT {k.target} FROM {k.table})" for t, d in samples.DECLARED.items() for k in d.foreign_keys))
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each declared key, how many rows the relation leads from."""
    e, out = engine(spark, sf_dir), None
    for t, entity in e.catalog.entities.items():
        for r in entity.relations.values():
            if r.kind == "forward":
                n = e.connection(t, {f"{r.name}Exists": True}).total().select(F.lit(f"{t}.{r.here}").alias("key_column"), F.lit(r.table).alias("parent"), F.col("total_count").alias("rows_with_parent"))
                out = n if out is None else out.unionByName(n)
    return out


@add("catalog_enum", "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
def catalog_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in engine(spark, sf_dir, "events").catalog.infer_enum("events", "event_type")], "value string")


@add("introspection", f"SELECT {_CAMEL} AS field, CASE WHEN column_name = 'o_orderstatus' THEN 'OrderOOrderstatus' ELSE {_SCALAR} END AS scalar FROM information_schema.columns WHERE table_name = 'orders'")
def introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = engine(spark, sf_dir, "orders").graphql('{ __type(name: "Order") { fields { name type { name kind } } } }')["data"]["__type"]["fields"]
    return spark.createDataFrame([(f["name"], f["type"]["name"]) for f in fields if f["name"] != "nodeId"], "field string, scalar string")


@add("document_parts", "SELECT 'Nation' AS kind, n_nationkey AS key, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 10")
def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases, fragments, variables and directives."""
    text = """
      query Q($least: Int = 3, $all: Boolean!) { found: nations(first: 100, filter: {nNationkey: {greaterThan: $least}}) { nodes { ...Part unasked: nName @skip(if: $all) } } }
      fragment Part on Nation { kind: __typename key: nNationkey ... on Nation { nName @include(if: $all) } region: regionByNRegionkey { rName } }"""
    nodes = engine(spark, sf_dir, "nation", "region").graphql(text, {"least": 10, "all": True})["data"]["found"]["nodes"]
    return spark.createDataFrame([(n["kind"], n["key"], n["nName"], n["region"]["rName"]) for n in nodes if "unasked" not in n], "kind string, key int, name string, region string")


@add("wire_forms", "SELECT l.l_orderkey::VARCHAR AS order_key, l.l_linenumber AS line, l.l_quantity AS quantity, strftime(l.l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped, o.o_orderstatus AS status FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IN (1, 2, 3, 4, 5, 6, 7)")
def wire_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit numbers are text, others numbers, times ISO text without parts of seconds, enumerations names."""
    query = "{ lineitems(first: 100, filter: {lOrderkey: {in: [1, 2, 3, 4, 5, 6, 7]}}) { nodes { lOrderkey lLinenumber lQuantity lShipdate orderByLOrderkey { oOrderstatus } } } }"
    nodes = engine(spark, sf_dir, "lineitem", "orders").graphql(query)["data"]["lineitems"]["nodes"]
    rows = [(n["lOrderkey"], n["lLinenumber"], n["lQuantity"], n["lShipdate"], (n["orderByLOrderkey"] or {}).get("oOrderstatus")) for n in nodes]
    return spark.createDataFrame([r for r in rows if r[4] is not None], "order_key string, line int, quantity double, shipped string, status string")


@add("nodes_of_types", "SELECT 'Customer' AS kind, c_name AS name FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'Nation', n_name FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'Supplier', s_name FROM supplier WHERE s_suppkey = 5")
def nodes_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field for rows of any type, by node ids; an id that no row has is null, and one of no table an error."""
    e = engine(spark, sf_dir, "customer", "nation", "supplier")
    query = "query($id: ID!) { node(nodeId: $id) { __typename ... on Customer { name: cName } ... on Nation { name: nName } ... on Supplier { name: sName } } }"
    answers = e.batch([{"query": query, "variables": {"id": codec.node_id(t, [k])}} for t, k in (("customer", 5), ("nation", 5), ("supplier", 5), ("customer", -1), ("nowhere", 1))])
    nodes = [a["data"]["node"] for a in answers if "errors" not in a]
    return spark.createDataFrame([(n["__typename"], n["name"]) for n in nodes if n is not None], "kind string, name string")


@add("batch", "SELECT 0 AS place, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, count(*) FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 2, NULL")
def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without rows, one request after another; one with an error doesn't stop the others."""
    asked = ("{ found: orders(filter: {oOrderstatus: {equalTo: F}}) { totalCount } }", "{ query { found: lineitems(filter: {lQuantity: {greaterThan: 40}}) { totalCount } } }", "{ found: orders(first: 1, last: 1) { totalCount } }")
    answers = engine(spark, sf_dir, "orders", "lineitem").batch([{"query": q} for q in asked])
    found = [(a["data"].get("query") or a["data"])["found"]["totalCount"] if a["data"] else None for a in answers]
    return spark.createDataFrame(list(enumerate(found)), "place int, n long")


@add("history_off", f"SELECT user_id, event_type, count(*) AS n FROM {_STATE} GROUP BY ALL")
def history_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without history every version is a row."""
    e = Engine(derived(spark, sf_dir).catalog, Options(timeout_s=None, historical=False))
    return e.connection("state", point=5000).filtered().groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@add("versions_in_order", f"SELECT user_id, valid_from, row_number() OVER (ORDER BY user_id, valid_from)::INT AS place FROM {_STATE} ORDER BY user_id, valid_from LIMIT 100")
def versions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a row, which share its key, stand by their start."""
    e = Engine(derived(spark, sf_dir).catalog, Options(timeout_s=None, historical=False))
    got = e.connection("state", order=["USER_ID_ASC"], first=100).fetch().rows
    return spark.createDataFrame([(r["user_id"], r["valid_from"], i + 1) for i, r in enumerate(got)], "user_id long, valid_from long, place int")


@add("history_argument", f"SELECT user_id::VARCHAR AS user_id, event_type FROM {_STATE} WHERE valid_from <= 900 AND (valid_to IS NULL OR 900 < valid_to) ORDER BY user_id::BIGINT LIMIT 100")
def history_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the argument that asks for a point is told by the metadata."""
    c = derived(spark, sf_dir).catalog
    told = lambda: spark.createDataFrame([("historicalStateEnabled", '"timestamp"')], "key string, value string")
    e = Engine(Catalog(spark, {"state": c.sources["state"]}, {"state": Declared(key=("user_id",), versions=("valid_from", "valid_to"))}, {"_metadata": told}), Options(timeout_s=None, point_argument=None))
    nodes = e.graphql('{ states(timestamp: "900", first: 100, orderBy: [USER_ID_ASC]) { nodes { userId eventType } } }')["data"]["states"]["nodes"]
    return spark.createDataFrame([(n["userId"], n["eventType"]) for n in nodes], "user_id string, event_type string")


@add("metadata_merged", "SELECT 'lastProcessedHeight' AS field, max(event_id)::VARCHAR AS value FROM events UNION ALL SELECT 'targetHeight', count(*)::VARCHAR FROM lineitem UNION ALL SELECT 'startHeight', NULL")
def metadata_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's fields come before those that a service tells."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    table = lambda: read("events").select(F.lit("lastProcessedHeight").alias("key"), F.max("event_id").cast("string").alias("value"))
    told = lambda: {"targetHeight": read("lineitem").count(), "lastProcessedHeight": -1}
    e = Engine(Catalog(spark, {"nation": lambda: read("nation")}, {}, {"_metadata": table}), Options(timeout_s=None), told)
    got = e.graphql("{ _metadata { lastProcessedHeight targetHeight startHeight } }")["data"]["_metadata"]
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in got.items()], "field string, value string")


@add("change_payloads", f"SELECT event_id::VARCHAR AS id, {_KIND} AS mutation_type FROM events WHERE event_id % 3 = 0 AND {_KIND} <> 'DELETE'")
def change_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from lines of text on the channel of one table; what is no payload is dropped."""
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.expr(_KIND.replace("'DELETE'", "'VANISH'")).alias("mutation_type")))
    line = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.lit("{not json")).otherwise(F.lit('{"id": null, "mutation_type": "INSERT"}'))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(line.alias("value"), F.lit(channel("app", "events", "entity_change")).alias("topic"))
    other = lines.select("value", F.lit(channel("app", "orders", "entity_change")).alias("topic"))
    return parsed(lines.unionByName(other), table=("app", "events")).select("id", "mutation_type")


@add("request_cost", "SELECT count(*) AS n, 6 AS complexity, 4 AS depth, 1 AS aliases FROM region")
def request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, their nesting and renamed ones, of a request that is just within its limits; one less of each is an error."""
    query = "{ all: regions { totalCount nodes { rName nationsByNRegionkey { totalCount } } } }"
    doc = parse(query)
    cost = {"complexity": complexity(doc, doc.operations[0].selection), "depth": depth(doc, doc.operations[0].selection), "aliases": aliases(doc, doc.operations[0].selection)}
    c = engine(spark, sf_dir, "region", "nation").catalog
    got = Engine(c, Options(timeout_s=None, limits=Limits(**cost))).graphql(query)
    refused = [Engine(c, Options(timeout_s=None, limits=Limits(**{k: v - 1}))).graphql(query).get("errors") for k, v in cost.items()]
    n = got["data"]["all"]["totalCount"] if got["extensions"]["complexity"] == cost["complexity"] and all(refused) else -1
    return spark.createDataFrame([(n, *cost.values())], "n long, complexity int, depth int, aliases int")


FLAGSHIP = "order_by"
